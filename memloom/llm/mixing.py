"""Mixing to target weights by soft membership.

A classifier fitted on labelled rows predicts each document's posterior over domains. Nonnegative
document rates r minimise

    1/2 sum_k (T_k(r) / N - budget * target_k)^2 + ridge / 2 * sum_d (n_d / N) (r_d - 1)^2

where n_d are tokens, N their sum and T_k(r) = sum_d r_d n_d p_dk the expected tokens of domain k.
Accelerated projected gradient in the token-weighted metric has step 1 / (1 + ridge). One iteration
is one distributed sum of two numbers more than there are domains. A document's rate depends only on its
posterior and on the gradients so far, so tasks replay those instead of storing rates. The start is the
solution on a bounded sample (``SAMPLE`` rows by hash order), so few iterations over all rows are left; they
end when the gradient mapping proves the objective within ``GAP`` of its least value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import hash_sample, map_texts, materialize
from memloom.llm.linear import MAX_SAMPLE, LinearModel, featurizer, fit
from memloom.llm.toxicity import labelled_sample

RIDGE = 1e-3
SAMPLE = 20_000
#: Of squared shares of all tokens: a domain's share is then within about its root of the best one.
GAP = 1e-7
#: Far beyond what a ridge of 1e-3 takes; reaching it is an error.
MOST_ROUNDS = 400
SUMS = pa.schema([("domain", pa.int32()), ("total", pa.float64())])


def fit_domains(
    docs: DataFrame, labels: DataFrame, domains: dict[str, str], id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_SAMPLE
) -> LinearModel:
    """Softmax over domains; ``domains`` maps names to boolean SQL over ``labels`` (the first that holds wins)."""
    case = "CASE " + " ".join(f"WHEN {e} THEN {i}" for i, e in enumerate(domains.values())) + " END"
    _, sample, ys = labelled_sample(docs, labels, {"domain": case}, id_col, text_col, limit)
    return fit(sample, np.eye(len(domains))[ys["domain"]])


def posteriors(docs: DataFrame, model: LinearModel, text_col: str = "text", need_text: bool = False) -> DataFrame:
    """``docs`` with n_tokens and posterior (array, in the order of the domains). No words: zero tokens, even posterior."""
    k = len(model.bias)

    def make():
        features = featurizer()

        def one(raw):
            n, buckets = features(raw)
            return n, model.probabilities(buckets).tolist() if n else [1 / k] * k

        return one

    return map_texts(docs, text_col, make, {"n_tokens": pa.int64(), "posterior": pa.list_(pa.float64())}, need_text)


def replay(p: np.ndarray, gradients: list[np.ndarray], ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates, look-ahead rates and the last gradient mapping of documents with posteriors p.

    The first of ``gradients`` is the start: the domain gradient whose fixed point the first rates are.
    """
    rate = ahead = np.maximum(0, 1 - p @ gradients[0] / ridge)
    step, t, mapping = 1 / (1 + ridge), 1.0, np.zeros(len(p))
    for g in gradients[1:]:
        new = np.maximum(0, ahead - step * (p @ g + ridge * (ahead - 1)))
        mapping = (ahead - new) / step
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - rate)
        rate, t = new, t_new
    return rate, ahead, mapping


def _sums(p, n, gradients, ridge) -> np.ndarray:
    """Expected tokens by domain at the look-ahead rates, tokens, and the weighted square of the last mapping."""
    _, ahead, mapping = replay(p, gradients, ridge)
    return np.array([*((ahead * n) @ p), n.sum(), (n * mapping * mapping).sum()])


def _matrix(batch, k):
    return batch.column("posterior").flatten().to_numpy().reshape(-1, k)


def _totals(gradients, ridge, k):
    def run(batches):
        total = np.zeros(k + 2)
        for batch in batches:
            if batch.num_rows:
                total += _sums(_matrix(batch, k), batch.column("n_tokens").to_numpy(), gradients, ridge)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 2), pa.int32()), pa.array(total)], schema=SUMS)

    return run


def descend(sums, goal: np.ndarray, start: np.ndarray, ridge: float, gap: float) -> list[np.ndarray]:
    """Domain gradients from a start until the objective is within ``gap`` of the least; ``sums(gradients)`` gives ``_sums``."""
    k, gradients = len(goal), [start]
    for i in range(MOST_ROUNDS):
        total = sums(gradients)
        if total[k] == 0:
            return gradients
        # Strong convexity: the gap is at most half the squared gradient mapping over the ridge.
        if i and total[k + 1] / total[k] <= 2 * ridge * gap:
            return gradients
        gradients.append(total[:k] / total[k] - goal)
    raise RuntimeError(f"rates did not settle in {MOST_ROUNDS} rounds")


def fit_rates(
    soft: DataFrame, targets: list[float], budget: float = 1.0, ridge: float = RIDGE, gap: float = GAP, sample: int = SAMPLE
) -> list[np.ndarray]:
    """Domain gradients, the start and one a round, that determine all rates. ``soft``: n_tokens, posterior (stored)."""
    k = len(targets)
    goal = budget * np.asarray(targets, float) / sum(targets)
    slim = soft.select("n_tokens", "posterior").where("n_tokens > 0")
    few = hash_sample(slim, ["n_tokens", "posterior"], slim.count(), sample).toArrow().combine_chunks()  # ``sample`` rows
    p, n = few.column("posterior").combine_chunks().flatten().to_numpy().reshape(-1, k), few.column("n_tokens").to_numpy()
    start = descend(lambda g: _sums(p, n, g, ridge), goal, np.zeros(k), ridge, gap / 100)
    # The gradient at the sample's rates, whose fixed point they are.
    at_end = (n * replay(p, start, ridge)[0]) @ p / n.sum() - goal if len(n) else np.zeros(k)

    def sums(gradients):
        got = slim.mapInArrow(_totals(list(gradients), ridge, k), "domain int, total double").groupBy("domain").agg(F.sum("total").alias("t"))
        found = {x["domain"]: x["t"] for x in got.collect()}  # domains + 2 numbers
        return np.array([found.get(i, 0.0) for i in range(k + 2)])

    return descend(sums, goal, at_end, ridge, gap)


def with_rates(soft: DataFrame, gradients: list[np.ndarray], domains: int, ridge: float = RIDGE) -> DataFrame:
    """``soft`` with column rate."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = [c for c in soft.columns if c != "rate"]
    out = StructType([*[soft.schema[c] for c in names], StructField("rate", DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rate = replay(_matrix(batch, domains), gradients, ridge)[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*names, "rate"])

    return soft.select(*names).mapInArrow(run, out)


def mix_to_targets(
    docs: DataFrame,
    labels: DataFrame,
    domains: dict[str, str],
    targets: dict[str, float],
    budget: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Id (and ``keep`` columns), n_tokens, posterior, rate of each document.

    Targets are weights over the domains; ``budget`` is the total wanted as a share of all tokens. Null
    and blank texts have no tokens and do not count. Repeated rows are documents of their own; an empty
    table gives no rows; other columns are not read. Very long texts are one row like others.
    """
    model = fit_domains(docs, labels, domains, id_col, text_col)
    base = docs.select(*dict.fromkeys([id_col, text_col, *keep]))
    soft = materialize(posteriors(base, model, text_col, need_text=text_col in keep))
    gradients = fit_rates(soft, [targets[d] for d in domains], budget)
    return with_rates(soft, gradients, len(domains))
