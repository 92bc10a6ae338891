"""Language ID: script ranges narrow candidates, Viterbi over per-word scores labels spans.

Learning counts hashed character trigrams of every training text (no sample) and, per language,
its letters by script. A word is a run of letters; its score under a language is the sum of the
log-probabilities of its trigrams. A language takes part in a word only if that word's script holds
at least ``SCRIPT_SHARE`` of the language's letters. Viterbi over the words, with a penalty for
each change of language, labels spans; the label with the most letters names the document.
"""

from __future__ import annotations

import dataclasses
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import batches_of, map_texts, prepared, raw_texts

#: First code points of scripts (fixed values of Unicode's block layout) and their names.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7FC, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x33480, "other"),
)
NAMES = tuple(sorted({n for _, n in SCRIPTS}))
SCRIPT_SHARE = 0.005
BUCKET_BITS = 15
SWITCH = 20.0
OUT = -1e6


@functools.cache
def _tables():
    top = 0x33480
    letter = np.zeros(0x110000, bool)
    letter[:top] = [chr(i).isalpha() for i in range(top)]
    script = np.zeros(0x110000, np.uint8)
    for (a, name), (b, _) in zip(SCRIPTS, (*SCRIPTS[1:], (0x110000, ""))):
        script[a:b] = NAMES.index(name)
    return letter, script


def letters_of(raw: bytes | None):
    """Trigram bucket of each letter, first letter of each word, script of each letter; None if no letter."""
    if not raw:
        return None
    letter, script = _tables()
    c = np.frombuffer(raw.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[c]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = np.where(is_letter, c, 32)[keep].astype(np.uint64)
    x = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    at = np.flatnonzero(x != 32)
    h = x[at - 1] * np.uint64(0x9E3779B1) + x[at] * np.uint64(0x85EBCA77C2B2AE63) + x[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
    first = np.flatnonzero(x[at - 1] == 32)
    return h.astype(np.int64), first, script[x[at].astype(np.int64)]


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    """Languages in order, log-probabilities (bucket x language), candidates (script x language), log priors."""

    languages: tuple[str, ...]
    logp: np.ndarray
    allowed: np.ndarray
    prior: np.ndarray


#: About as many as have a two-letter code; 32 768 counts each.
MOST_LANGUAGES = 200
COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])


def _counts(batches):
    """Sparse counts of a task; buckets beyond the trigrams count letters by script, the last documents."""
    size = (1 << BUCKET_BITS) + len(NAMES) + 1
    total: dict[str, np.ndarray] = {}
    held: dict[str, list] = {}

    def fold(lang):
        total[lang] = total.get(lang, 0) + np.bincount(np.concatenate(held.pop(lang)), minlength=size)

    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), raw_texts(batch, "text")):
            if (found := letters_of(raw)) is not None:
                h, _, script = found
                held.setdefault(lang, []).append(np.concatenate([h, script.astype(np.int64) + (1 << BUCKET_BITS), [size - 1]]))
                if len(held[lang]) >= 256:
                    fold(lang)
    for lang in list(held):
        fold(lang)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield from batches_of(COUNTS, [np.full(len(at), lang, object), at, n[at]])


def learn_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Counts over all rows with text and language. The driver gets languages x buckets counts at most.

    More than ``MOST_LANGUAGES`` distinct values of ``lang_col`` are an error: that column names no languages.
    """
    rows = prepared(docs, text_col, lang_col).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.where("lang is not null and text is not null").mapInArrow(_counts, "lang string, bucket long, n long")
    named = rows.where("lang is not null and text is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if named > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages in {lang_col}")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    dense = np.zeros(((1 << BUCKET_BITS) + len(NAMES) + 1, len(languages)))
    dense[got["bucket"].to_numpy(np.int64), np.searchsorted(languages, got["lang"].to_numpy(str)) if len(languages) else []] = got["n"]
    grams, scripts, n_docs = dense[: 1 << BUCKET_BITS], dense[1 << BUCKET_BITS : -1], dense[-1]
    logp = np.log((grams + smoothing) / (grams.sum(0) + smoothing * len(grams)))
    return LanguageModel(
        languages, logp.astype(np.float32), scripts >= SCRIPT_SHARE * scripts.sum(0), np.log(n_docs / max(n_docs.sum(), 1))
    )


def viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of rows of scores, each change of label costing ``switch``; ties to the lower label.

    If no stretch of rows gains ``switch`` or more by leaving the best single label, that label is the
    best path, as every stretch under another label needs a change of its own; only other texts take
    the recursion.
    """
    n, k = score.shape
    best = int(np.argmax(score.sum(0)))
    gain = np.cumsum(score - score[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(k), gain[:-1]]), axis=0)
    if not (gain - low >= switch).any():
        return np.full(n, best)
    rows, now = score.tolist(), score[0].tolist()
    back = []
    for t in range(1, n):
        top = max(now)
        arg = now.index(top)
        came, then, row = [0] * k, [0.0] * k, rows[t]
        for j in range(k):
            stay = now[j] >= top - switch
            came[j] = j if stay else arg
            then[j] = row[j] + (now[j] if stay else top - switch)
        back.append(came)
        now = then
    label = now.index(max(now))
    path = [label]
    for came in reversed(back):
        label = came[label]
        path.append(label)
    return np.array(path[::-1])


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def _label(model: LanguageModel, switch: float):
    names = model.languages

    def one(raw):
        found = letters_of(raw)
        if found is None or not names:
            return "und", 0.0, []
        h, first, script = found
        score = np.add.reduceat(model.logp[h].astype(np.float64), first, axis=0)
        allowed = model.allowed[script[first]]
        known = allowed.any(axis=1)
        score = np.where(known[:, None], np.where(allowed, score, score + OUT), 0.0)
        if not known.any():  # scripts of no language learned
            return names[int(np.argmax(model.prior))], 0.0, []
        path = viterbi(score, switch)
        letters = np.diff(np.append(first, len(h)))
        share = np.bincount(path, weights=letters, minlength=len(names))
        best = int(np.argmax(share))
        mine = score[path == best].sum(0) + model.prior
        margin = mine[best] - max([x for i, x in enumerate(mine.tolist()) if i != best], default=-math.inf)
        cut = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        spans = [{"lang": names[path[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip(cut, [*cut[1:], len(path)])]
        return names[best], float(share[best] / len(h) / (1 + math.exp(-min(max(margin, -50), 50)))), spans

    return one


def identify_languages(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", need_text: bool = True, switch: float = SWITCH
) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and lang_spans (language, first word, words; words are runs of letters).

    Null text, or text without a letter: ``und``, score 0, no spans. Letters of scripts that no language
    was learned in: the most frequent language, score 0. With nothing learned all rows are ``und``.
    Columns named like the new ones are replaced; repeated rows stay.
    """
    fields = {"lang_pred": pa.string(), "score": pa.float64(), "lang_spans": SPANS}
    return map_texts(docs, text_col, lambda: _label(model, switch), fields, need_text)


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
