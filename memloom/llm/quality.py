"""Quality by weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Votes are counted by
pattern over all documents (at most 3**labellers rows reach the driver). Expectation-maximisation
on these counts estimates each labeller's accuracy and each pattern's posterior. The posteriors
train a hashed linear scorer on at most ``linear.MAX_SAMPLE`` rows; it scores every whole text.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import map_texts, materialize
from memloom.llm.linear import MAX_SAMPLE, LinearModel, featurizer, fit, fitting_rows

BAD, ABSTAIN, GOOD = 0, 1, 2
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~(_LETTER | _BLANK | _DIGIT)
_MARK[list(b".,;:'\"-!?()")] = False


def _vote(x: float, good: float, bad: float) -> int:
    """Good on the near side of ``good``, bad on the far side of ``bad``, else no vote."""
    if good <= bad:
        return GOOD if x <= good else BAD if x >= bad else ABSTAIN
    return GOOD if x >= good else BAD if x <= bad else ABSTAIN


#: Each kind of fault is seen by two labellers or more.
LABELLERS = ("marks", "odd_words", "capitals", "emphasis", "repeats", "variety", "repeated_lines", "sentence_ends", "word_length", "length")
_PLAIN = b".,;:'\"-!?()"


def votes(raw: bytes | None) -> list[int]:
    """The votes of all labellers on one text, in the order of ``LABELLERS``."""
    words = raw.split() if raw else []
    if not words:
        return [ABSTAIN] * 9 + [BAD]
    b = np.frombuffer(raw, np.uint8)
    solid = max(1, len(b) - int(_BLANK[b].sum()))
    letters = max(1, int(_LETTER[b].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    # Bare marks, and words that end in marks other than a sentence's or in two and more of those.
    odd = sum(not (w[-1:].isalnum() or w[-1] > 127 or (w[-1] in _PLAIN and len(w) > 1 and w[-2:-1] != w[-1:])) for w in words)
    again = sum(a == c for a, c in zip(words, words[1:]))
    return [
        _vote(int(_MARK[b].sum()) / solid, 0.02, 0.08),
        _vote(odd / n, 0.1, 0.3),
        _vote(int(_UPPER[b].sum()) / letters, 0.15, 0.5),
        _vote(raw.count(b"!!") / n, 0.02, 0.2),
        _vote(again / n, 0.05, 0.2) if n >= 10 else ABSTAIN,
        _vote(len(set(words)) / n, 0.3, 0.15) if n >= 50 else ABSTAIN,
        _vote(1 - len(set(lines)) / len(lines), 0.2, 0.5) if len(lines) > 3 else ABSTAIN,
        _vote(sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), 0.6, 0.2),
        _vote(abs(solid / n - 5.5), 3.0, 6.0),
        _vote(n, 3, 0),
    ]


def pattern_of(raw: bytes | None) -> int:
    return sum(v * 3**i for i, v in enumerate(votes(raw)))


def unpack(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**i % 3 for i in range(len(LABELLERS))], axis=1)


@dataclasses.dataclass(frozen=True)
class WeakLabels:
    """P(good), and P(vote | class, a vote) by labeller, class (bad, good) and vote (bad, abstain, good).

    Abstaining says nothing: its entries are one. Else short texts, on which many abstain, would become the
    hidden class.
    """

    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = unpack(np.asarray(patterns, np.int64))
        logs = np.log(self.table)[np.arange(len(LABELLERS))[None, :], :, v].sum(1) + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among those a labeller gives."""
        weight = np.array([1 - self.prior, self.prior])
        right = self.table[:, 0, BAD] * weight[0] + self.table[:, 1, GOOD] * weight[1]
        given = ((self.table[:, :, BAD] + self.table[:, :, GOOD]) * weight).sum(1)
        return dict(zip(LABELLERS, (right / given).tolist()))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> WeakLabels:
    """Class-conditional vote tables from pattern counts.

    The start doubts a document at the first bad vote: labellers look for different faults, so a bad text is
    good to most of them.
    """
    v = unpack(np.asarray(patterns, np.int64))
    good = np.clip(0.95 - 0.45 * (v == BAD).sum(1) - 0.4 * ~(v == GOOD).any(1), 0.05, 0.95)
    onehot = (v[:, :, None] == np.arange(3)).astype(float)
    model = WeakLabels(0.5, np.ones((len(LABELLERS), 2, 3)))
    for _ in range(rounds if len(v) else 0):
        w = np.stack([counts * (1 - good), counts * good], axis=1)
        table = np.einsum("pc,plv->lcv", w, onehot) + 1.0
        table[:, :, ABSTAIN] = 0
        prior = (w[:, 1].sum() + 1) / (w.sum() + 2)
        table = table / table.sum(2, keepdims=True)
        table[:, :, ABSTAIN] = 1
        model = WeakLabels(float(prior), table)
        good = model.posterior(patterns)
    return model


@dataclasses.dataclass(frozen=True)
class QualityModel:
    weak: WeakLabels
    scorer: LinearModel


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_SAMPLE) -> QualityModel:
    """Vote counts over all documents, then the scorer on a bounded sample of them."""
    base = docs.select(F.col(id_col).alias("wl_id"), F.col(text_col).alias("wl_text_in"))
    voted = map_texts(base, "wl_text_in", lambda: lambda raw: (pattern_of(raw),), {"pattern": pa.int32()}, need_text=False)
    voted = materialize(voted)
    counted = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toPandas()
    weak = expectation_maximisation(counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(float))
    # Of several texts under one id the least pattern stands for the id.
    keys = voted.where("wl_id is not null").groupBy("wl_id").agg(F.min("pattern").alias("pattern"))
    ids, sample, got = fitting_rows(base, keys, "wl_id", "wl_text_in", limit)
    good = weak.posterior(got["pattern"]) if len(ids) else np.zeros(0)
    scorer = fit(sample, np.stack([1 - good, good], axis=1))
    return QualityModel(weak, scorer)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", need_text: bool = False) -> DataFrame:
    """``docs`` with p_weak (posterior of the votes) and quality (the linear scorer's probability).

    Null and blank texts: the posterior of their votes, quality 0. Columns named like the new ones are
    replaced, repeated rows stay, an empty table gives none.
    """

    def make():
        features, known = featurizer(), {}

        def one(raw):
            p = pattern_of(raw)
            if p not in known:
                known[p] = float(model.weak.posterior(np.array([p]))[0])
            n, buckets = features(raw)
            return known[p], float(model.scorer.probabilities(buckets)[1]) if n else 0.0

        return one

    return map_texts(docs, text_col, make, {"p_weak": pa.float64(), "quality": pa.float64()}, need_text)
