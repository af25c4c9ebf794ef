"""Column functions on ISO dates kept as text. The day that ages are counted to is always given, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_AGE_DAYS = 90
VERIFIED = "VERIFICADO"


def _day(c: Column) -> Column:
    """The date of a text that is a calendar day in ISO form, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def is_iso_date(c: Column) -> Column:
    return _day(c).isNotNull()


def days_since(c: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), _day(c))


def is_stale(c: Column, as_of: str, max_age: int = MAX_AGE_DAYS) -> Column:
    """Older than max_age days, or not a date."""
    return F.coalesce(days_since(c, as_of) > max_age, F.lit(True))


def needs_reverify(c: Column, as_of: str, max_age: int = MAX_AGE_DAYS) -> Column:
    """As the statistics count it: by the fraction of a day (as_of may have a time); a malformed date is not due."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(_day(c).cast("timestamp"))
    return c.isNull() | F.coalesce(age > max_age * 86_400, F.lit(False))


def derived_status(status: Column, verified: Column, as_of: str, max_age: int = MAX_AGE_DAYS) -> Column:
    """A verified record whose date is stale is due again; without a status it is pending."""
    due = F.when(is_stale(verified, as_of, max_age), "REVERIFICAR").otherwise(VERIFIED)
    return F.when(status == VERIFIED, due).otherwise(F.coalesce(status, F.lit("PENDIENTE")))
