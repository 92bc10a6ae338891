"""Toxicity by a classifier chain.

Categories are predicted one after another: each linear model sees the hashed text features and the
probabilities of the categories before it. While fitting, those probabilities are out-of-fold
predictions (``FOLDS`` folds by hash of the id), so a later model learns how far earlier ones can be
trusted. Fitting takes at most ``linear.MAX_SAMPLE`` labelled rows; every whole text is scored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import map_texts
from memloom.llm.linear import MAX_SAMPLE, LinearModel, featurizer, fit, fitting_rows

FOLDS = 4


@dataclasses.dataclass(frozen=True)
class ToxicityChain:
    categories: tuple[str, ...]
    models: tuple[LinearModel, ...]

    def score(self, buckets: np.ndarray) -> list[float]:
        out: list[float] = []
        for model in self.models:
            out.append(float(model.probabilities(buckets, out)[1]))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: dict[str, str], id_col: str, text_col: str, limit: int):
    """Ids, features and label values of the labelled texts that a model is fitted on (see ``linear.fitting_rows``).

    ``columns`` names SQL expressions over the labels. Rows with a null id, text or label are left out, and so are
    ids whose rows of labels contradict each other; rows that agree count once.
    """
    keys = labels.select(F.col(id_col).alias("wl_id"), *[F.expr(e).cast("int").alias(f"wl_y_{n}") for n, e in columns.items()]).dropna()
    agreed = keys.groupBy("wl_id").agg(*[f(f"wl_y_{n}").alias(f"{a}_{n}") for n in columns for a, f in (("lo", F.min), ("hi", F.max))])
    for n in columns:
        agreed = agreed.where(F.col(f"lo_{n}") == F.col(f"hi_{n}"))
    agreed = agreed.select("wl_id", *[F.col(f"lo_{n}").alias(f"wl_y_{n}") for n in columns])
    ids, sample, got = fitting_rows(docs, agreed, id_col, text_col, limit)
    return ids, sample, {n: got[f"wl_y_{n}"] for n in columns}


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_SAMPLE
) -> ToxicityChain:
    """Fit the chain; ``categories`` maps names, in order, to SQL expressions over ``labels``."""
    ids, sample, ys = labelled_sample(docs, labels, categories, id_col, text_col, limit)
    fold = np.array([xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 7) % FOLDS for i in ids], int)
    extra, models = np.zeros((len(ids), 0)), []
    for i, y in enumerate(ys.values()):
        target = np.stack([1 - y, y], axis=1).astype(float)
        models.append(fit(sample, target, extra))
        if i + 1 < len(ys):
            guess = np.full(len(ids), float(y.mean()) if len(ids) else 0.0)
            for k in range(FOLDS):
                inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                if len(inside) and len(outside):
                    part, held = fit(sample.take(inside), target[inside], extra[inside]), sample.take(outside)
                    starts = np.append(0, held.ends[:-1])
                    guess[outside] = [
                        part.probabilities(held.flat[a:b], extra[j])[1] for a, b, j in zip(starts, held.ends, outside)
                    ]
            extra = np.column_stack([extra, guess])
    return ToxicityChain(tuple(categories), tuple(models))


def score_toxicity(docs: DataFrame, chain: ToxicityChain, text_col: str = "text", need_text: bool = False) -> DataFrame:
    """``docs`` with p_<category> for each category of the chain.

    Null and blank texts have probability 0 throughout. Columns named like the new ones are replaced,
    repeated rows stay, an empty table gives none.
    """

    def make():
        features = featurizer()

        def one(raw):
            n, buckets = features(raw)
            return tuple(chain.score(buckets)) if n else (0.0,) * len(chain.categories)

        return one

    return map_texts(docs, text_col, make, {f"p_{c}": pa.float64() for c in chain.categories}, need_text)
