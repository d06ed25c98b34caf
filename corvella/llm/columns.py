"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and what a line is stripped of.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas.

    A projection below would be folded back into the lambda by the optimiser and
    then be computed for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def carried(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct column, __row, beside columns of the operator's own: no name in docs can clash with them."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), *[v.alias(k) for k, v in more.items()])


def restored(rows: DataFrame, names: list[str], *more: Column, **new: Column) -> DataFrame:
    """The carried columns again, those in `new` replaced, then more."""
    return rows.select(*[(new[c] if c in new else F.col("__row").getField(c)).alias(c) for c in names], *more)


def words(text: Column) -> Column:
    """Maximal runs of anything but the six blanks; none for null."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does the same, and faster, where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def hex_sha256(text: Column) -> Column:
    return F.sha2(text, 256)
