"""Column functions that classify access, prices, credentials and level by explicit evidence alone.

Where the evidence is missing or contradictory the answer is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import clean, decoded, once, pattern, says

# What counts as evidence.
PRICE_FREE = r"\bprice\s*:?\s*free"
AMOUNT = r"\s*:?\s*(?:us)?\$\s*([0-9,]+(?:\.[0-9]{2})?)"
PRICE_WORDS = ("price", "cost", "tuition")
FREE_ACCESS = (
    r"\bfree\*?\b",
    r"\baudit (this course )?for free\b",
    r"\bgratis\b",
    r"\bacceso (libre|gratuito)\b",
    r"\bsin costo\b",
    PRICE_FREE,
)
FREE_PRICE = r"\b(free|gratis|sin costo|no cost)\b"
OTHER_MONEY = r"[€£¥₹]|\b(eur|gbp|jpy|clp|mxn|cop|ars|brl)\b"
DOLLARS = r"(?:us\$|usd|\$)\s*([0-9.,]+)"
CERTIFICATE = r"\b(certificate|certificado|certification)\b"
BADGE = r"\b(badge|insignia|digital badge)\b"
STATEMENT = r"\b(statement of accomplishment|declaraci[oó]n de logro)\b"
FREE_CREDENTIAL = r"\b(free certificate|certificado gratuito|certificate.{0,20}free|no cost certificate)\b"
VERIFIABLE = r"\b(verified|verifiable|verificable|shareable)\b"
LEVELS = (
    (r"\b(introductory|beginner|introductorio|principiante|b[aá]sico)\b", "introductorio"),
    (r"\b(intermediate|intermedio)\b", "intermedio"),
    (r"\b(advanced|avanzado|graduate)\b", "avanzado"),
)
EVIDENCE = {
    "mentions_free": r"\b(free|gratis|gratuito|sin costo)\b",
    "mentions_certificate": CERTIFICATE,
    "mentions_badge": r"\b(badge|insignia)\b",
    "mentions_audit": r"\b(audit|auditar)\b",
}


def _number(c: Column) -> Column:
    """The number at the start of c once its thousands' commas go."""
    return F.regexp_extract(F.replace(c, F.lit(",")), r"^[0-9]*\.?[0-9]*", 0).try_cast("double")


def access_price(text: Column) -> Column:
    """Dollars asked for access: 0 if said to be free, else by price, cost and tuition, in this order."""
    found = F.when(says(text, PRICE_FREE), 0.0)
    for word in PRICE_WORDS:
        found = F.coalesce(found, _number(F.regexp_extract(text, pattern(rf"\b{word}{AMOUNT}"), 1)))
    # most texts name no price: one look settles them
    return F.when(says(text, rf"\b({'|'.join(PRICE_WORDS)})\s*:?\s*(?:free|(?:us)?\$)"), found)


def mentions_free_access(text: Column) -> Column:
    return says(text, *FREE_ACCESS)


def access(text: Column) -> Column:
    said = F.struct(access_price(text).alias("price"), mentions_free_access(text).alias("free"))
    paid = lambda x: F.when(x.price > 0, F.when(~x.free, "pagado")).when((x.price == 0) | x.free, "gratis")
    return once(said, paid)


def is_paid(text: Column) -> Column:
    return F.coalesce(access(text) == "pagado", F.lit(False))


def price_usd(text: Column) -> Column:
    """A price in dollars: 0 for free words, null for other money or none."""
    t = clean(text)
    return F.when(says(t, FREE_PRICE), 0.0).when(
        ~says(t, OTHER_MONEY), _number(F.regexp_extract(t, pattern(DOLLARS), 1))
    )


def price_or_null(number: Column) -> Column:
    """A number as a price: null if negative or not finite."""
    return F.when((number >= 0) & (number < float("inf")), number)


def credential(text: Column, price: Column, is_badge: Column | None = None) -> Column:
    t = F.coalesce(F.lower(clean(text)), F.lit(""))
    free = says(t, FREE_CREDENTIAL)
    costless = F.coalesce(price == 0, F.lit(False)) | free
    badge = says(t, BADGE) if is_badge is None else says(t, BADGE) | F.coalesce(is_badge, F.lit(False))
    paid = F.when(says(t, VERIFIABLE), "certificado pagado verificable").otherwise("certificado pagado")
    return (
        F.when(badge & costless, "badge gratuito")
        .when(says(t, STATEMENT), "declaracion de logro")
        .when(says(t, CERTIFICATE) & costless, "certificado gratuito")
        .when(says(t, CERTIFICATE) & (price > 0), paid)
    )


def level(text: Column) -> Column:
    def first(t: Column) -> Column:
        return F.coalesce(*[F.when(says(t, p), name) for p, name in LEVELS])

    return once(decoded(text), first)


def evidence(text: Column) -> list[Column]:
    return [says(text, p).alias(name) for name, p in EVIDENCE.items()]
