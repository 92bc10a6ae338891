"""What the corpus operators share: written intermediate tables, row keys and Arrow output."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.session import ship
from memloom.sources.store import written as materialize  # noqa: F401  (the operators take it from here)

def prepared(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, with the package known to the executors."""
    ship(docs.sparkSession)
    return docs.select(*columns)


def hash_sample(rows: DataFrame, key: list[str], total: int, limit: int) -> DataFrame:
    """At most ``limit`` of ``total`` rows, by hash order of the key. Most others go before anything is sorted."""
    h = F.xxhash64(F.lit(11), *key)
    if total > 2 * limit:
        rows = rows.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 1.5 * limit / total))
    return rows.orderBy(h, *key).limit(limit)


def row_key(id_col: str, text_col: str):
    """A 64-bit key of a row by id and text; equal rows have equal keys, nulls included."""
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(text_col), F.col(text_col).isNull())


def raw_texts(batch: pa.RecordBatch, name: str):
    """The texts of a batch as bytes (None for null), one at a time."""
    return (x.as_py() for x in batch.column(name).cast(pa.binary()))


def longs(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)


def batches_of(schema: pa.Schema, columns: list, step: int = 65_536):
    """Record batches of bounded size from whole columns (numpy arrays or lists)."""
    n = len(columns[0])
    for i in range(0, n, step):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[i : i + step], f.type) for c, f in zip(columns, schema)], schema=schema
        )


def map_texts(docs: DataFrame, text_col: str, make, fields: dict[str, pa.DataType], need_text: bool = True) -> DataFrame:
    """``docs`` with new columns from each whole text.

    ``make()`` runs once a task and gives a function from bytes (None for null) to a tuple of values,
    one per field. Columns of ``docs`` with a new name are replaced. Without ``need_text`` the text
    itself is not sent back. Output batches hold about 8 MB of text at most.
    """
    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    ship(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in fields and (need_text or f.name != text_col)]
    names = [f.name for f in keep]
    # Arrow functions see columns by position: the text goes first, under no name of the table's.
    sent = docs.select(F.col(f"`{text_col}`").alias("wl_text"), *[F.col(f"`{n}`").alias(f"wl_{i}") for i, n in enumerate(names)])
    out = StructType(
        [StructField(f"wl_{i}", f.dataType, True) for i, f in enumerate(keep)]
        + [StructField(f"wl_new_{n}", from_arrow_type(t), True) for n, t in fields.items()]
    )
    types = list(fields.values())

    def run(batches):
        work = make()
        for batch in batches:
            start, held, rows = 0, 0, []
            for i, raw in enumerate(raw_texts(batch, "wl_text")):
                rows.append(work(raw))
                held += len(raw or b"")
                if held > 8_000_000 or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    new = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(part.columns[1:] + new, names=[f.name for f in out.fields])
                    start, held, rows = i + 1, 0, []

    done = sent.mapInArrow(run, out)
    return done.toDF(*names, *fields)
