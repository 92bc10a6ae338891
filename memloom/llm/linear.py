"""Hashed linear models: features of whole texts, and softmax regression with soft targets.

Features are present or absent: each distinct word, lower-cased without the ASCII punctuation around
it; each distinct shape (the punctuation after a word, all-capital words, bare marks); the first five
letters of words; those of them that begin at least three distinct words and one in a hundred; and two
levels of words that repeat the word before. Fitting
takes a sample of at most ``MAX_SAMPLE`` rows and ``MAX_SAMPLE_BYTES`` of text (documented bounds, by hash
order of the id); scoring covers all rows.
"""

from __future__ import annotations

import dataclasses
import itertools
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import hash_sample, map_texts, materialize
from memloom.llm.textcore import WordCache, split_words

BUCKETS = 1 << 18
MAX_SAMPLE = 12_000
#: Bytes of text of those rows; their features take a few times as much on the driver.
MAX_SAMPLE_BYTES = 96_000_000
MIN_DOCS = 3
#: A bucket takes part if its rows' targets lie this many standard deviations off the mean of some class.
LEAST_Z = 3.5
PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def _bucket(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x) & (BUCKETS - 1)


def word_features(word: bytes) -> int:
    """Three buckets of 18 bits in one number: the bare word, its shape and its beginning."""
    bare = word.strip(PUNCTUATION)
    if word.isascii():
        low = bare.lower()
        begins = low[:5] if len(low) >= 5 else b""
    else:
        text = bare.decode("utf-8", "replace").lower()
        low, begins = text.encode(), text[:5].encode() if len(text) >= 5 else b""
    tail = word[len(word.rstrip(PUNCTUATION)) :] if len(bare) < len(word) else b""
    shape = tail + (b"\x01" if len(bare) > 1 and bare.isupper() else b"") + (b"" if bare else b"\x02")
    return _bucket(low) << 36 | _SHAPES[shape] << 18 | _bucket(b"\x03" + begins)


_SHAPES = WordCache(lambda shape: _bucket(b"\x00" + shape), 20_000)


def featurizer():
    """A function from a text to (number of words, its distinct buckets)."""
    cache = WordCache(word_features, 500_000)
    low = np.uint64(BUCKETS - 1)
    often = np.uint64(0x2F5A1)
    repeats = np.array([_bucket(b"\x04"), _bucket(b"\x05")], np.uint64)

    def features(raw):
        words = split_words(raw)
        if not words:
            return 0, np.zeros(0, np.int64)
        again = sum(map(operator.eq, words, itertools.islice(words, 1, None))) / len(words)
        distinct = set(words)
        x = np.fromiter(map(cache.__getitem__, distinct), np.uint64, len(distinct))
        begins, times = np.unique(x & low, return_counts=True)
        much = begins[times >= max(3, 0.01 * len(distinct))] ^ often
        both = [x >> np.uint64(36), x >> np.uint64(18) & low, begins, much]
        both.append(repeats[: (again >= 0.05) + (again >= 0.3)])
        return len(words), np.unique(np.concatenate(both)).astype(np.int64)

    return features


def sample_features(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with column ``buckets`` in place of the text."""

    def make():
        f = featurizer()
        return lambda raw: (f(raw)[1].astype(np.int32),)

    return map_texts(rows, text_col, make, {"buckets": pa.list_(pa.int32())}, need_text=False)


def fitting_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, limit: int = MAX_SAMPLE, limit_bytes: int = MAX_SAMPLE_BYTES):
    """(ids, sample, the other columns of ``keys``) of the rows that a model is fitted on, gathered on the driver.

    ``keys`` has distinct ids ``wl_id`` and narrow columns. By hash order of the id, at most ``limit`` of them take
    part; of several texts under one id the one of the least hash; rows in that order while their texts sum to
    ``limit_bytes`` at most (and always the first).
    """
    chosen = hash_sample(keys, ["wl_id"], keys.count(), limit)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("wl_id"), text.alias("wl_text_in")).where(text.isNotNull())
    one = rows.join(F.broadcast(chosen), "wl_id").groupBy(*chosen.columns).agg(F.min_by("wl_text_in", F.xxhash64("wl_text_in")).alias("wl_text_in"))
    one = materialize(one.withColumn("wl_size", F.octet_length("wl_text_in")).withColumn("wl_order", F.xxhash64("wl_id")))
    # ``limit`` rows of three numbers.
    sizes = one.select("wl_order", "wl_id", "wl_size").toPandas().sort_values(["wl_order", "wl_id"])
    fits = sizes["wl_size"].cumsum() <= limit_bytes
    last = int(max(fits.sum(), 1)) - 1
    if len(sizes) and last + 1 < len(sizes):
        end = sizes.iloc[last]
        one = one.where((F.col("wl_order") < int(end["wl_order"])) | ((F.col("wl_order") == int(end["wl_order"])) & (F.col("wl_id") <= int(end["wl_id"]))))
    got = sample_features(one.drop("wl_size", "wl_order"), "wl_text_in").toArrow()
    ids = got.column("wl_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    lists = got.column("buckets").combine_chunks()
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    sample = Sample.of([flat[offsets[i] : offsets[i + 1]] for i in order])
    return ids[order], sample, {n: got.column(n).to_numpy()[order] for n in keys.columns if n != "wl_id"}


@dataclasses.dataclass(frozen=True)
class Sample:
    """Rows of distinct buckets, flat, with the end of each row."""

    flat: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray]) -> Sample:
        return Sample(np.concatenate([*rows, np.zeros(0, np.int32)], dtype=np.int32, casting="same_kind"), np.cumsum([len(r) for r in rows]).astype(np.int64))

    def __len__(self):
        return len(self.ends)

    def take(self, which: np.ndarray) -> Sample:
        starts = np.append(0, self.ends[:-1])
        return Sample.of([self.flat[starts[i] : self.ends[i]] for i in which])

    def blocks(self, step: int = 256):
        """(buckets, row of each) of some rows at a time; what is made of whole rows is then small."""
        for i in range(0, len(self), step):
            ends = self.ends[i : i + step]
            first = self.ends[i - 1] if i else 0
            yield self.flat[first : ends[-1]], np.repeat(np.arange(i, i + len(ends)), np.diff(ends, prepend=first))


@dataclasses.dataclass(frozen=True)
class LinearModel:
    """Weights of hashed buckets and of dense extra inputs, and a bias, by class."""

    weights: np.ndarray
    extra: np.ndarray
    bias: np.ndarray

    def logits(self, buckets: np.ndarray, extra=()) -> np.ndarray:
        z = self.weights[buckets].sum(0) + self.bias
        return z + np.asarray(extra, float) @ self.extra if len(self.extra) else z

    def probabilities(self, buckets: np.ndarray, extra=()) -> np.ndarray:
        return softmax(self.logits(buckets, extra)[None, :])[0]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _sums(sample: Sample, weights: np.ndarray, step: int = 1024) -> np.ndarray:
    out = np.zeros((len(sample), weights.shape[1]))
    starts = np.append(0, sample.ends[:-1])
    for i in range(0, len(sample), step):
        a, b = starts[i : i + step], sample.ends[i : i + step]
        total = np.vstack([np.zeros(weights.shape[1]), np.cumsum(weights[sample.flat[a[0] : b[-1]]], axis=0, dtype=np.float64)])
        out[i : i + step] = total[b - a[0]] - total[a - a[0]]
    return out


def fit(sample: Sample, target: np.ndarray, extra: np.ndarray | None = None, steps: int = 60, rate: float = 0.15, ridge: float = 5e-4) -> LinearModel:
    """Softmax regression by full-batch Adam steps; targets are class probabilities (rows sum to 1).

    Buckets of fewer than ``MIN_DOCS`` sampled rows, and those that no class depends on by ``LEAST_Z``, keep
    weight zero: a few marked words must stand out of thousands of indifferent ones. Deterministic.
    """
    n, k = target.shape
    extra = np.zeros((n, 0)) if extra is None else extra
    freq, seen = np.zeros(BUCKETS, np.int64), np.zeros((k, BUCKETS))
    for flat, of_row in sample.blocks():
        freq += np.bincount(flat, minlength=BUCKETS)
        for j in range(k):
            seen[j] += np.bincount(flat, weights=target[of_row, j], minlength=BUCKETS)
    mean = target.mean(0) if n else np.zeros(k)
    z = np.zeros(BUCKETS)
    for j in range(k):
        spread = np.sqrt(freq * mean[j] * (1 - mean[j]) * np.maximum(1 - freq / max(n, 1), 1e-9)) + 1e-9
        z = np.maximum(z, np.abs(seen[j] - freq * mean[j]) / spread)
    live = np.flatnonzero((freq >= MIN_DOCS) & (z >= LEAST_Z))
    place = np.full(BUCKETS, len(live), np.int32)
    place[live] = np.arange(len(live))
    parts, counts = [np.zeros(0, np.int32)], np.zeros(n, np.int64)
    for flat, of_row in sample.blocks():
        at = place[flat]
        kept = at < len(live)
        parts.append(at[kept])
        counts += np.bincount(of_row[kept], minlength=n)
    ends = np.cumsum(counts)
    local = Sample(np.concatenate(parts), ends)
    rows = np.repeat(np.arange(n), np.diff(np.append(0, ends)))
    size = len(live) + extra.shape[1] + 1
    w, m, v = np.zeros((size, k)), np.zeros((size, k)), np.zeros((size, k))
    w[-1] = np.log(np.maximum(target.mean(0), 1e-6)) if n else 0
    decay = np.full((size, 1), ridge)
    decay[-1] = 0
    for t in range(1, steps + 1 if n else 1):
        z = _sums(local, w[: len(live)]) + extra @ w[len(live) : -1] + w[-1]
        error = (softmax(z) - target) / n
        g = np.empty_like(w)
        for j in range(k):
            g[: len(live), j] = np.bincount(local.flat, weights=error[rows, j], minlength=len(live))[: len(live)]
        g[len(live) : -1], g[-1] = extra.T @ error, error.sum(0)
        g += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    full = np.zeros((BUCKETS, k), np.float32)
    full[live] = w[: len(live)]
    return LinearModel(full, w[len(live) : -1].copy(), w[-1].copy())
