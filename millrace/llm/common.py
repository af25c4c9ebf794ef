"""What the training-data operators share: words, and the library's written tables and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.tables import components, materialize, settled, shared_dir

#: The six ASCII separators of the word definition [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it a name that df has no column of (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


__all__ = ["ascii_lower", "columns_of", "components", "materialize", "settled", "shared_dir", "spare", "words"]
