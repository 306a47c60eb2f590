"""Values as change logs carry them, turned into values of the target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def enum_label(ordinal: Column, labels: list[str]) -> Column:
    """The label of an ENUM ordinal; 0 is the empty text, ordinals beyond the labels are null."""
    names = F.array(*map(F.lit, labels))
    return F.when(ordinal == 0, F.lit("")).when((ordinal > 0) & (ordinal <= len(labels)), F.element_at(names, ordinal.cast("int")))


def set_labels(mask: Column, labels: list[str]) -> Column:
    """The labels of a SET bit mask, comma-joined in their order; 0 is the empty text."""
    names = F.array(*(F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(x).alias("label")) for i, x in enumerate(labels)))
    chosen = F.filter(names, lambda x: mask.cast("long").bitwiseAND(x["bit"]) != 0)
    return F.array_join(F.transform(chosen, lambda x: x["label"]), ",")


def zero_date_to_null(text: Column) -> Column:
    """Dates of year zero have no counterpart."""
    return F.when(~text.startswith("0000-00-00"), text)


def bits(value: Column, width: int) -> Column:
    """A BIT value: a boolean of width 1, else the smallest integer type that holds it."""
    if width == 1:
        return value.cast("long") != 0
    return value.cast("short" if width <= 8 else "int" if width <= 16 else "long" if width <= 63 else "decimal(20,0)")


def preview_text(c: Column, most: int = 500) -> Column:
    """Text cut for display."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def preview_binary(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit("<binary "), F.octet_length(c).cast("string"), F.lit(" bytes>")))
