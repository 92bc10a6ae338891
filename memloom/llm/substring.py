"""Substring dedup by difference-cover anchors.

A window is ``min_words`` consecutive words. Every word covered by a window whose word sequence
also starts at another place (any document, the same one included) is removed.

Method. Let ``v`` be the period and ``D`` a difference cover modulo ``v``: every residue is a
difference of two members of ``D``. Anchors are windows of ``w = min_words - v + 1`` words that
start at places p with ``p mod v`` in ``D``. For two equal long windows at i and j some offset
k < v puts both i + k and j + k on cover places, so they share the anchor at that offset. Only
about ``sqrt(v)/v`` of all places are hashed and shuffled. An anchor that occurs twice makes the
long windows around it candidates; a candidate is extended to its whole ``min_words`` words and
kept as repeated only if that whole sequence (80 hash bits, and those of its bucket) occurs twice.

Exact copies of a whole text need no windows: all of theirs repeat. Per group of equal texts (80 hash
bits and those of the bucket) one document sends its windows, marked as repeated, so that others find them.

Skew: each task folds equal keys of its own rows before the shuffle, so a passage or a text that a third
of the corpus shares reaches a reducer at most once per task and chunk. Copies are never paired or joined.

What travels: a task cuts its records by bucket of their key and sends one compressed block of columns a
bucket. There are as many buckets as keep one at about ``BUCKET_BYTES`` of text; what returns, which is less,
goes by bucket of its row, of which there are fewer. Texts are shuffled once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import prepared, raw_texts
from memloom.llm.textcore import MULT_A, MULT_B, WindowHash, WordCache, mix, runs_to_mask, split_words, word_hash

#: Windows held by a task before it folds and emits them.
CHUNK = 600_000
#: Bytes of text whose records make a bucket.
BUCKET_BYTES = 48_000_000
DEALT = pa.schema([("wl_bucket", pa.int32()), ("wl_kind", pa.int8()), ("wl_block", pa.binary())])
DEALT_SQL = "wl_bucket int, wl_kind byte, wl_block binary"
#: Bytes of each column of a block; negative: of its differences.
ANCHOR, WINDOW, MARK, OWN = (6, -8, 2, -4), (8, 2, -8, 2, -4), (-8, 2, -4), (2, -4)
#: Kinds of blocks: anchors, digests of whole texts, and places that are known to repeat.
ANCHORS, TEXTS, KNOWN = 0, 1, 2
#: Places that say of a whole text: it is a copy, and the one that sends the windows of its group.
COPY, SPEAKER = np.uint64(1 << 31), np.uint64((1 << 31) + 1)
ONE = np.uint64(1)
ZSTD = pa.Codec("zstd")


def difference_cover(v: int) -> tuple[int, ...]:
    """A small set D with {a - b mod v} = all residues, by depth-first search from the least possible size."""

    def extend(chosen, start, size):
        if len({(a - b) % v for a in chosen for b in chosen}) == v:
            return chosen
        if len(chosen) == size:
            return None
        for x in range(start, v):
            if found := extend((*chosen, x), x + 1, size):
                return found
        return None

    size = 1
    while size * (size - 1) + 1 < v:
        size += 1
    while True:
        if found := extend((0,), 1, size):
            return found
        size += 1


def cover_for(min_words: int) -> tuple[int, int, tuple[int, ...]]:
    """Anchor width, period and cover for a window length: a period of three fifths, 31 at most."""
    v = max(1, min(31, (3 * min_words) // 5))
    return min_words - v + 1, v, difference_cover(v)


def pack(columns: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    """Columns of unsigned numbers as one compressed block: the low bytes of each, byte by byte."""
    planes = []
    for x, w in zip(columns, widths):
        x = np.diff(x, prepend=np.uint64(0)) if w < 0 else x
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, : abs(w)].T).tobytes())
    return len(columns[0]).to_bytes(4, "little") + ZSTD.compress(b"".join(planes), asbytes=True)


def unpack(block: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(block[:4], "little"), 0, []
    raw = np.frombuffer(ZSTD.decompress(block[4:], n * sum(map(abs, widths)), asbytes=True), np.uint8)
    for w in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, : abs(w)] = raw[at : at + n * abs(w)].reshape(abs(w), n).T
        at, x = at + n * abs(w), x.view(np.uint64).ravel()
        out.append(np.cumsum(x, dtype=np.uint64) & np.uint64((1 << 8 * -w) - 1) if w < 0 else x)
    return out


def _gathered(table: pa.Table, kind: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The columns of all blocks of a kind."""
    kinds = table.column("wl_kind").to_numpy()
    parts = [unpack(b.as_py(), widths) for b, k in zip(table.column("wl_block"), kinds) if k == kind]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.uint64) for _ in widths]


def _dealt(kind: int, by: np.ndarray, buckets: int, columns: list[np.ndarray], widths: tuple[int, ...]):
    """(bucket, kind, block) rows; the order of the columns is kept within a bucket."""
    b = (by % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b, columns = b[order], [c[order] for c in columns]
    at = np.flatnonzero(np.diff(b, prepend=-1, append=-1)) if len(b) else np.zeros(0, np.int64)
    return [(int(b[i]), kind, pack([c[i:j] for c in columns], widths)) for i, j in zip(at, at[1:])]


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), DEALT)] if rows else [pa.array([], f.type) for f in DEALT], schema=DEALT)


def _groups(*keys: np.ndarray):
    """The order by keys, which places of it begin a group, and the size of each place's group."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    counts = np.diff(np.append(np.flatnonzero(new), len(order)))
    return order, new, np.repeat(counts, counts)


def _tag(raw: bytes) -> np.uint64:
    """Tells the texts of one row key apart."""
    return np.uint64(xxhash.xxh3_64_intdigest(raw, 5) & 0xFFFF)


def _folded(keys: list[np.ndarray], rest: list[np.ndarray]):
    """The first record of each key with its flag (the low bit of the last column) set if there are more; and the others."""
    order, new, counts = _groups(*keys)
    first, others = order[new], order[~new]
    more = np.zeros(len(order), bool)
    more[order] = counts > 1
    first.sort()
    rest = [*rest[:-1], rest[-1] | more.astype(np.uint64)]
    return [c[first] for c in (*keys, *rest)], [c[others] for c in rest]


def _anchors(min_words: int, buckets: int, row_buckets: int):
    width, period, cover = cover_for(min_words)
    on_cover = np.zeros(period, bool)
    on_cover[list(cover)] = True

    def run(batches):
        cache, window = WordCache(word_hash), WindowHash(MULT_A)
        held, texts, size = [], [], 0

        def flush():
            keys, *rest = (np.concatenate(x) for x in zip(*held))
            (keys, *first), (rows, tags, places) = _folded([keys], rest)
            out = _dealt(ANCHORS, keys, buckets, [keys >> np.uint64(16), *first], ANCHOR)
            known = [(rows, tags, places >> ONE)]
            a, b, rows, tags, places = (np.array(c, np.uint64) for c in zip(*texts))
            first, (rows, tags, _) = _folded([a, b], [rows, tags, places])
            out += _dealt(TEXTS, first[0] ^ first[1], buckets, first, WINDOW)
            known.append((rows, tags, np.full(len(rows), COPY)))
            known = [np.concatenate(c) for c in zip(*known)]
            return _batch(out + _dealt(KNOWN, mix(known[0]), row_buckets, known, MARK))

        for batch in batches:
            for row, raw in zip(batch.column("wl_row").to_numpy().view(np.uint64), raw_texts(batch, "wl_text")):
                words = split_words(raw)
                if len(words) < min_words:
                    continue
                h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                at = np.arange(len(h) - width + 1)
                at = at[on_cover[at % period]]
                tag, d = _tag(raw), xxhash.xxh3_128_intdigest(raw)
                held.append((window.at(window.prefix(h), at, width), np.full(len(at), row), np.full(len(at), tag), at.astype(np.uint64) << ONE))
                texts.append((d >> 64, d & 0xFFFF, row, tag, 0))
                size += len(at)
                if size >= CHUNK:
                    yield flush()
                    held, texts, size = [], [], 0
        if held:
            yield flush()

    return run


def _repeated(row_buckets: int):
    """Places of anchors that repeat, and marks of copies, by bucket of their row."""

    def run(table: pa.Table) -> pa.Table:
        keys, *rest = _gathered(table, ANCHORS, ANCHOR)
        order, _, counts = _groups(keys)
        rows, tags, places = (c[order] for c in rest)
        hit = (counts > 1) | (places & ONE > 0)
        out = [(rows[hit], tags[hit], places[hit] >> ONE)]
        a, b, rows, tags, flags = _gathered(table, TEXTS, WINDOW)
        order, new, counts = _groups(a, b)
        # Groups again, with the least row first.
        order = order[np.lexsort((tags[order], rows[order], np.cumsum(new)))]
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else order
        rows, tags, flags = rows[order], tags[order], flags[order]
        speaks = (rows == rows[first]) & (tags == tags[first])
        hit = (counts > 1) | (flags & ONE > 0)
        out.append((rows[hit], tags[hit], np.where(speaks, SPEAKER, COPY)[hit]))
        out.append(_gathered(table, KNOWN, MARK))
        out = [np.concatenate(c) for c in zip(*out)]
        return pa.Table.from_batches([_batch(_dealt(KNOWN, mix(out[0]), row_buckets, out, MARK))])

    return run


def _unique(row_buckets: int):
    """Places of windows that occur once, by bucket of their row."""

    def run(table: pa.Table) -> pa.Table:
        a, b, *rest = _gathered(table, ANCHORS, WINDOW)
        order, _, counts = _groups(a, b)
        rows, tags, places = (c[order] for c in rest)
        once = (counts == 1) & (places & ONE == 0)
        out = [rows[once], tags[once], places[once] >> ONE]
        return pa.Table.from_batches([_batch(_dealt(KNOWN, mix(out[0]), row_buckets, out, MARK))])

    return run


OF_ROW = pa.schema([("wl_row", pa.int64()), ("wl_places", pa.binary())])


def _of_rows(table: pa.Table) -> pa.Table:
    """One block of places a row."""
    rows, tags, places = _gathered(table, KNOWN, MARK)
    order = np.lexsort((places, tags, rows))
    rows, tags, places = rows[order], tags[order], places[order]
    at = np.append(np.flatnonzero(np.diff(rows, prepend=~rows[:1])), len(rows))
    blocks = [pack([tags[i:j], places[i:j]], OWN) for i, j in zip(at, at[1:])]
    return pa.table([pa.array(rows[at[:-1]].view(np.int64)), pa.array(blocks, pa.binary())], schema=OF_ROW)


def _places(block, tag: np.uint64) -> np.ndarray:
    """The places that a row's block (a scalar, null for none) has for the text of this tag."""
    if not block.is_valid:
        return np.zeros(0, np.uint64)
    tags, places = unpack(block.as_py(), OWN)
    return places[tags == tag]


def _candidates(n: int, anchors: np.ndarray, min_words: int) -> np.ndarray:
    """Starts of the long windows that hold a repeated anchor."""
    width, period, _ = cover_for(min_words)
    starts = n - min_words + 1
    a = np.unique(anchors[anchors < COPY]).astype(np.int64)
    if not len(a) or starts <= 0:
        return np.zeros(0, np.int64)
    low = np.maximum(a - (period - 1), 0)
    d = np.zeros(starts + period + width + 1, np.int32)
    np.add.at(d, low[low < starts], 1)
    np.add.at(d, np.minimum(a + 1, starts)[low < starts], -1)
    return np.flatnonzero(np.cumsum(d[:starts]) > 0)


def _windows(min_words: int, buckets: int):
    def run(batches):
        cache, wa, wb = WordCache(word_hash), WindowHash(MULT_A), WindowHash(MULT_B)
        held, size = [], 0

        def flush():
            a, b, *rest = (np.concatenate(x) for x in zip(*held))
            first, _ = _folded([a, b], rest)  # the others are known to repeat
            return _batch(_dealt(ANCHORS, first[0] ^ first[1], buckets, first, WINDOW))

        for batch in batches:
            for row, raw, block in zip(batch.column("wl_row").to_numpy().view(np.uint64), raw_texts(batch, "wl_text"), batch.column("wl_places")):
                words = split_words(raw)
                if len(words) < min_words:
                    continue
                tag = _tag(raw)
                marks = _places(block, tag)
                speaks = bool((marks == SPEAKER).any())
                if not speaks and (marks == COPY).any():  # a copy of a document that sends its windows
                    continue
                at = _candidates(len(words), marks, min_words)
                if len(at):
                    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                    key = wa.at(wa.prefix(h), at, min_words)
                    check = wb.at(wb.prefix(mix(h)), at, min_words) >> np.uint64(48)
                    held.append((key, check, np.full(len(at), row), np.full(len(at), tag), at.astype(np.uint64) << ONE | np.uint64(speaks)))
                    size += len(at)
                    if size >= CHUNK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


CLEANED = "wl_id long, n_words long, n_removed long, kept_text string"


def _clean(min_words: int):
    schema = pa.schema(
        [("wl_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]
    )

    def repeated(words, raw, marks, unique):
        if len(words) < min_words:
            return np.zeros(0, np.int64)
        tag = _tag(raw)
        marks = _places(marks, tag)
        if (marks >= COPY).any():
            return np.arange(len(words) - min_words + 1)
        at = _candidates(len(words), marks, min_words)
        return at[~np.isin(at, _places(unique, tag).astype(np.int64))]

    def run(batches):
        for batch in batches:
            ids, total, gone, kept, held = [], [], [], [], 0
            for i, raw in enumerate(raw_texts(batch, "wl_text")):
                words = split_words(raw)
                at = repeated(words, raw, batch.column("wl_places")[i], batch.column("wl_unique")[i])
                if len(at):
                    mask = runs_to_mask(len(words), at, min_words)
                    gone.append(int(mask.sum()))
                    text = b" ".join([w for w, m in zip(words, mask.tolist()) if not m])
                else:
                    gone.append(0)
                    text = b" ".join(words)
                ids.append(batch.column("wl_id")[i].as_py())
                total.append(len(words))
                kept.append(text.decode())
                held += len(text)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, total, gone, kept), schema)], schema=schema)
                    ids, total, gone, kept, held = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, total, gone, kept), schema)], schema=schema)

    return run


def substring_dedup(docs: DataFrame, min_words: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (kept words joined by one space).

    Null text: no words, kept_text empty. Fewer than ``min_words`` words: nothing is removed.
    Repeated rows (equal id and text, null ids too) count as other places, so all their windows go;
    several texts under one id are separate documents. An empty table gives no rows; other columns
    are not read. Ids are integers.
    """
    # The row key: id and 12 bits of the text's hash, which packs better than a hash of both; a tag of 16 more
    # bits goes with each place. Null ids have a hash of the text.
    some = F.xxhash64(F.lit(3), F.col(text_col), F.col(text_col).isNull())
    place = F.coalesce(F.shiftleft(F.col(id_col).cast("long"), 12).bitwiseXOR(some.bitwiseAND(F.lit(4095))), some)
    base = prepared(docs, id_col, text_col).select(
        place.alias("wl_row"), F.col(id_col).cast("long").alias("wl_id"), F.col(text_col).alias("wl_text")
    )
    total = base.agg(F.sum(F.octet_length("wl_text")).alias("n")).first()["n"] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, math.ceil(total / BUCKET_BYTES))
    row_buckets = max((partitions + 1) // 2, math.ceil(total / (8 * BUCKET_BYTES)))

    def by_row(found: DataFrame) -> DataFrame:
        return found.groupBy("wl_bucket").applyInArrow(_of_rows, "wl_row long, wl_places binary")

    # All columns go into the functions, so both joins on the row key share one exchange of the texts.
    anchors = base.mapInArrow(_anchors(min_words, buckets, row_buckets), DEALT_SQL)
    marks = by_row(anchors.groupBy("wl_bucket").applyInArrow(_repeated(row_buckets), DEALT_SQL))
    windows = base.join(marks, "wl_row").mapInArrow(_windows(min_words, buckets), DEALT_SQL)
    unique = by_row(windows.groupBy("wl_bucket").applyInArrow(_unique(row_buckets), DEALT_SQL)).withColumnRenamed("wl_places", "wl_unique")
    cleaned = base.join(marks.join(unique, "wl_row", "left"), "wl_row", "left").mapInArrow(_clean(min_words), CLEANED)
    return cleaned.withColumnRenamed("wl_id", id_col)
