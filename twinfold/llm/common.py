"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinfold.operators.shared import BATCH, BROADCAST_BYTES, broadcast_if_small, checkpointed, numbered, text_batches  # noqa: F401

#: Characters between words, as a regex class body.
SPACE = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def with_columns(docs: DataFrame, text_col: str, start: Callable, new: dict[str, str]) -> DataFrame:
    """``docs`` with new columns (name: type) that Python makes from the texts, in Arrow batches.

    ``start()`` is called once per task and gives a function from an Arrow array of texts to one
    array per new column. Columns of ``docs`` with one of the new names, in any case, are replaced.
    """
    taken = {n.lower() for n in new}
    if text_col.lower() in taken:
        raise ValueError(f"a new column would replace the text column {text_col}")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    at = [c.lower() for c in kept.columns].index(text_col.lower())
    schema = StructType(list(kept.schema.fields))
    for name, kind in new.items():
        schema = schema.add(name, kind)
    names = schema.names

    def run(batches):
        import pyarrow as pa

        made = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made(batch.column(at)))], names)

    return text_batches(kept).mapInArrow(run, schema)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns of these names, in any case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
