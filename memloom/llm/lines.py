"""Line dedup on content-defined chunks of lines.

A line's hash is the first 32 bits of its MD5. A chunk ends after a line (not the first of its
document) where the rolling hash 31 * previous + own is divisible by ``MEAN_LINES``; documents end
chunks too. Boundaries depend on two lines only, so they move along with the text. A chunk of two or
more lines that occurs more than once in the corpus stays at its first place, by id and line, and goes
elsewhere, after its bytes were compared with those of the chunk that stays.

A copied passage that holds no whole chunk is missed by this rule. With ``runs`` the units are instead all windows of
``RUN`` lines, overlapping: a line goes exactly if it lies in a run of two or more lines that stands at an earlier place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import materialize, prepared, raw_texts, row_key
from memloom.operators.skew import hot_at, with_groups

MEAN_LINES = 4
#: Lines of a window; longer runs are chains of windows.
RUN = 2
CHUNKS = pa.schema([(n, pa.int64()) for n in ("ln_row", "ln_id", "ln_first", "ln_count", "ln_d1", "ln_d2")])


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def chunk_ends(lines: list[bytes], mean: int = MEAN_LINES) -> list[int]:
    """Ends (exclusive) of the chunks of a document."""
    if not lines:
        return []
    ends, before = [], line_hash(lines[0])
    for i in range(1, len(lines)):
        own = line_hash(lines[i])
        if (31 * before + own) % mean == 0:
            ends.append(i + 1)
        before = own
    return ends if ends and ends[-1] == len(lines) else [*ends, len(lines)]


def spans_of(lines: list[bytes], mean: int, runs: bool) -> list[tuple[int, int]]:
    """(first, count) of the units of a document that are looked up: chunks, or windows that hold more than blanks."""
    if runs:
        filled = [bool(x.strip()) for x in lines]
        return [(i, RUN) for i in range(len(lines) - RUN + 1) if any(filled[i : i + RUN])]
    ends = chunk_ends(lines, mean)
    return [(a, b - a) for a, b in zip([0, *ends], ends) if b - a > 1]


def _chunks(mean: int, runs: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for row, i, raw in zip(batch.column("ln_row").to_pylist(), batch.column("ln_id").to_pylist(), raw_texts(batch, "ln_text")):
                if raw is None:
                    continue
                lines = raw.split(b"\n")
                for first, count in spans_of(lines, mean, runs):
                    d = xxhash.xxh3_128_intdigest(b"\n".join(lines[first : first + count]))
                    rows.append((row, i, first, count, d >> 64, d & ((1 << 64) - 1)))
            if rows:
                cols = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[4:]]
                yield pa.RecordBatch.from_arrays(arrays, schema=CHUNKS)

    return run


TAKEN = pa.schema([*[(n, pa.int64()) for n in ("ln_row", "f", "c", "d1", "d2", "parts")], ("stays", pa.bool_()), ("t", pa.binary())])


def _take(batches):
    """The bytes of wanted chunks."""
    for batch in batches:
        out, held = [], 0
        for i, (row, raw) in enumerate(zip(batch.column("ln_row").to_pylist(), raw_texts(batch, "ln_text"))):
            lines = raw.split(b"\n")
            for w in batch.column("ln_wanted")[i].as_py():
                t = b"\n".join(lines[w["f"] : w["f"] + w["c"]])
                out.append((row, w["f"], w["c"], w["d1"], w["d2"], w["parts"], w["stays"], t))
                held += len(t)
            if out and (held > 8_000_000 or i + 1 == batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), TAKEN)], schema=TAKEN)
                out, held = [], 0


def _clean(names):
    new = (pa.int64(), pa.int64(), pa.string())

    def run(batches):
        for batch in batches:
            start, out, held = 0, [], 0
            rest = batch.select([n for n in batch.schema.names if n not in ("ln_row", "ln_text", "ln_spans")])
            for i, raw in enumerate(raw_texts(batch, "ln_text")):
                spans = batch.column("ln_spans")[i].as_py()
                lines = raw.split(b"\n") if raw is not None else []
                text, n = raw, 0
                if spans:
                    gone = np.zeros(len(lines), bool)
                    for s in spans:
                        gone[s["f"] : s["f"] + s["c"]] = True
                    text, n = b"\n".join([x for x, g in zip(lines, gone.tolist()) if not g]), int(gone.sum())
                out.append((len(lines), n, None if text is None else text.decode()))
                held += len(raw or b"")
                if held > 8_000_000 or i + 1 == batch.num_rows:
                    arrays = [pa.array(list(c), t) for c, t in zip(zip(*out), new)]
                    yield pa.RecordBatch.from_arrays([*rest.slice(start, i + 1 - start).columns, *arrays], names=names)
                    start, out, held = i + 1, [], 0

    return run


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN_LINES, keep: tuple[str, ...] = (), runs: bool = False
) -> DataFrame:
    """One row per document: id, the columns ``keep``, n_lines, n_removed, kept_text.

    Null text: no lines, kept_text null. A text of one line is never changed. Null ids come first when
    the place that stays is chosen. Rows equal in id and text are treated alike: if one keeps a chunk,
    all do. An empty table gives no rows; other columns are not read.
    """
    base = prepared(docs, *dict.fromkeys([id_col, text_col, *keep])).select(
        row_key(id_col, text_col).alias("ln_row"),
        F.col(id_col).cast("long").alias("ln_id"),
        F.col(text_col).alias("ln_text"),
        *[F.col(k).alias(f"ln_k{i}") for i, k in enumerate(keep)],
    )
    long_rows = ", ".join(f"{f.name} long" for f in CHUNKS)
    chunks = materialize(base.select("ln_row", "ln_id", "ln_text").mapInArrow(_chunks(mean, runs), long_rows))
    total = chunks.count()
    place = F.struct(F.coalesce("ln_id", F.lit(-(1 << 63))).alias("i"), F.col("ln_first").alias("f"), F.col("ln_row").alias("r"))
    groups = (
        chunks.groupBy("ln_d1", "ln_d2")
        .agg(F.min(place).alias("first_place"), F.max(place).alias("last_place"), F.count(F.lit(1)).alias("ln_n"))
        .where("first_place <> last_place")
        .select("ln_d1", "ln_d2", "first_place", "ln_n")
    )
    # A chunk of very many places is compared in parts, each with its own copy of the bytes that stay.
    parts = F.ceil(F.col("ln_n") / F.lit(hot_at(total)))
    wanted = (
        with_groups(chunks, groups, ["ln_d1", "ln_d2"], "ln_n", total)
        .select(
            "ln_row",
            F.struct(
                F.col("ln_first").alias("f"), F.col("ln_count").alias("c"), F.col("ln_d1").alias("d1"), F.col("ln_d2").alias("d2"),
                parts.alias("parts"), (place == F.col("first_place")).alias("stays"),
            ).alias("w"),
        )
        .groupBy("ln_row")
        .agg(F.collect_set("w").alias("ln_wanted"))
    )
    # All columns go into the function, so both joins on the row key share one exchange of the texts.
    taken = base.join(wanted, "ln_row").mapInArrow(_take, "ln_row long, f long, c long, d1 long, d2 long, parts long, stays boolean, t binary")
    kept = (
        taken.where("stays").dropDuplicates(["d1", "d2"])
        .select("d1", "d2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("t").alias("kept_t"))
    )
    spans = (
        taken.where("not stays").withColumn("part", F.pmod(F.xxhash64("ln_row", "f"), F.col("parts")))
        .join(kept, ["d1", "d2", "part"])
        .where("t = kept_t")
        .groupBy("ln_row")
        .agg(F.collect_set(F.struct("f", "c")).alias("ln_spans"))
    )
    types = "".join(f", {f'ln_k{i}'} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))
    names = ["ln_id", *[f"ln_k{i}" for i in range(len(keep))], "n_lines", "n_removed", "kept_text"]
    cleaned = base.join(spans, "ln_row", "left").mapInArrow(_clean(names), f"ln_id long{types}, n_lines long, n_removed long, kept_text string")
    return cleaned.toDF(id_col, *keep, "n_lines", "n_removed", "kept_text")
