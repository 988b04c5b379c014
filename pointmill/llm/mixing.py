"""Mixing sources to target weights with soft membership.

A softmax regression over hashed text, fitted on a bounded sample of a labelled table (``max_train`` rows, proximal
AdaGrad with an L1 penalty), gives each document posteriors over domains, so a document belongs to several in part.
Nonnegative document rates r minimise

    1/2 (A r - T)' M (A r - T),   A_kd = tokens of d * posterior of domain k,   T_k = target share k * token budget

from r = 1 by projected gradients scaled by each document's tokens: r <- clip(r - D A' M (A r - T)) to 0 .. ``max_rate``, D = 1 / tokens,
so a rate depends on what a document is and not on how long it is. M is the inverse of A D A' (a K by K matrix, so one
aggregate gives it), which makes the step length 1 exact while no rate is cut at zero; further iterations settle those
that are. Each iteration is one pass over the documents' stored posteriors that folds the steps so far into each
document's rate and gives K sums, so no iteration writes or shuffles documents, and the plan keeps one size.

Every domain with a target is in the fit. Rates have no bound unless the caller gives one (``max_rate``); under a bound,
a domain out of reach gets as near to its target as the least squares bring it. Domains without a target are left out:
the others share their own tokens in the targets' proportions. ``fit_rates`` reports totals, targets and residuals by
domain and whether they are met, which ``mixing_rates`` and ``mixed`` log (as a warning where they are not).

Defined cases: null and blank texts have no tokens and rate 1, as they cannot change any total; labelled rows with a
null id or label are ignored; without any labelled row there is one domain ``all`` and the rates only match the budget;
repeated rows each get their rate; of domains with equal posteriors the first by name is the likeliest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .features import SIZE, WORDS, Rows, labelled_sample, places, shrink

LOG = logging.getLogger(__name__)
MAX_TRAIN = 8_000
ITERATIONS = 25
#: The most copies of a document that a mixture may ask for, where the caller gives no bound.
MAX_RATE = math.inf
#: Share of the mean diagonal added to A D A', against domains that nearly coincide.
RIDGE = 1e-6
#: Target shares of tokens: languages of good documents, and little of what labels call low or toxic.
TARGETS = {"en": 0.50, "fr": 0.20, "de": 0.18, "es": 0.10, "low": 0.02}


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, at: np.ndarray) -> np.ndarray:
        s = self.weights[at].sum(axis=0, dtype=np.float64) + self.bias
        p = np.exp(s - s.max())
        return p / p.sum()


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label) for the labelled documents: ``low`` where quality is 0 or toxic is 1, else the language."""
    low = (F.col("quality") == 0) | (F.col("toxic") == 1)
    judged = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(low).alias("low"))
    joined = docs.select("doc_id", "lang").join(judged, "doc_id")
    return joined.select("doc_id", F.when(F.col("low"), F.lit("low")).otherwise(F.col("lang")).alias("label"))


def fit(sample: list[tuple[str, np.ndarray]], l1: float = 4e-4, rate: float = 0.15, passes: int = 12, batch: int = 256) -> DomainModel:
    domains = sorted({d for d, _ in sample}) or ["all"]
    k = len(domains)
    w, bias = np.zeros((SIZE, k), np.float32), np.zeros(k)
    if k == 1:
        return DomainModel(domains, w, bias)
    y = np.array([domains.index(d) for d, _ in sample])
    rows = Rows([r for _, r in sample])
    seen, seen_b = np.full((SIZE, k), 1e-6, np.float32), np.full(k, 1e-6)
    rng = np.random.default_rng(3)
    for p in range(passes):
        order, step = rng.permutation(len(y)), rate * (1 - 0.9 * p / passes)
        for a in range(0, len(order), batch):
            take = order[a : a + batch]
            at, row = rows.batch(take)
            own, inverse = np.unique(at, return_inverse=True)
            s = np.stack([np.bincount(row, w[at, j], minlength=len(take)) for j in range(k)], axis=1) + bias
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
            s[np.arange(len(take)), y[take]] -= 1
            s /= len(take)
            gb = s.sum(axis=0)
            seen_b += gb * gb
            bias -= step * gb / np.sqrt(seen_b)
            g = np.stack([np.bincount(inverse, s[row, j], minlength=len(own)) for j in range(k)], axis=1).astype(np.float32)
            seen[own] += g * g
            scale = step / np.sqrt(seen[own])
            w[own] -= scale * g
            shrink(w, own, scale * np.where(own < WORDS, l1, l1 / 10).astype(np.float32)[:, None])
    return DomainModel(domains, w, bias)


def _posteriors(shared, text: str):
    """All columns of a row, its tokens and its posterior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sizes, post = [], []
            for t in batch.column(text):
                at, n = places(t.as_py())
                sizes.append(n)
                post.append(model.posterior(at))
            names = [name for name in batch.schema.names if name != "dropped_text"]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(sizes, pa.int64()), pa.array(post, pa.list_(pa.float64()))], [*names, "n_tokens", "posterior"])

    return run


def posteriors(docs: DataFrame, labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, posterior) of every document, stored; and the domains in the posterior's order."""
    model = fit(labelled_sample(docs, labelled, max_train))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.col("text").alias("dropped_text"))
    return stored(rows.mapInArrow(_posteriors(shared, "dropped_text"), "doc_id long, n_tokens long, posterior array<double>"), "posteriors"), model.domains


def _totals(steps: np.ndarray, place: list[int], max_rate: float):
    """Tokens of each domain at the rates that the steps so far give: one row of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(place))
        for batch in batches:
            n = np.asarray(batch.column("n_tokens")).astype(np.float64)
            p = np.asarray(batch.column("posterior").flatten()).reshape(len(n), -1)[:, place] if len(n) else np.zeros((0, len(place)))
            rate = np.ones(len(n))
            for y in steps:
                rate = np.clip(rate - p @ y, 0.0, max_rate)
            total += (rate * n) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"t{k}" for k in range(len(place))])

    return run


def rate_column(steps: np.ndarray, place: list[int], max_rate: float) -> Column:
    """The rate over (n_tokens, posterior): the steps are one literal that is folded, so the plan is as large for many as for few."""
    if not len(steps):
        return F.lit(1.0)
    own = F.array(*[F.get("posterior", F.lit(i)) for i in place])
    folded = F.aggregate(
        F.lit(steps.tolist()),
        F.lit(1.0),
        lambda rate, y: F.least(F.greatest(F.lit(0.0), rate - F.aggregate(F.zip_with(own, y, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)), F.lit(max_rate)),
    )
    return F.when(F.col("n_tokens") > 0, folded).otherwise(F.lit(1.0))


def fit_rates(post: DataFrame, domains: list[str], targets: Mapping[str, float], budget: float | None = None, iterations: int = ITERATIONS, tolerance: float = 1e-4, max_rate: float = MAX_RATE) -> tuple[Column, dict]:
    """The rate as a column over (n_tokens, posterior), and a report: totals before, after and aimed at, what is left, steps taken."""
    place = [domains.index(d) for d in domains if targets.get(d, 0.0) > 0] or list(range(len(domains)))
    total = float(post.agg(F.sum("n_tokens")).first()[0] or 0)
    domains = [domains[i] for i in place]
    k = len(domains)
    p = [F.get("posterior", F.lit(i)) for i in place]
    a = [F.col("n_tokens") * x for x in p]
    sums = post.agg(*[F.sum(x) for x in a], *[F.sum(a[i] * p[j]) for i in range(k) for j in range(k)]).first()
    now = np.array([float(x or 0) for x in sums[:k]])
    gram = np.array([float(x or 0) for x in sums[k : k + k * k]]).reshape(k, k)
    aim = np.array([targets.get(d, 0.0) for d in domains]) if any(d in targets for d in domains) else np.ones(k)
    # tokens of the domains without a target stay as they are
    goal = aim / aim.sum() * now.sum() * ((budget or total) / max(total, 1.0))
    report = {"domains": domains, "before": now.tolist(), "target": goal.tolist()}
    if not total:
        return F.lit(1.0), report | {"after": now.tolist(), "residual": (now - goal).tolist(), "iterations": 0, "met": True}
    metric = np.linalg.inv(gram + RIDGE * np.trace(gram) / k * np.eye(k))
    after, steps = now, np.zeros((0, k))
    schema = ", ".join(f"t{i} double" for i in range(k))
    while not (met := bool(np.abs(after - goal).max() <= tolerance * total)) and len(steps) < iterations:
        steps = np.vstack((steps, metric @ (after - goal)))
        row = post.select("n_tokens", "posterior").mapInArrow(_totals(steps, place, max_rate), schema).agg(*[F.sum(f"t{i}") for i in range(k)]).first()
        after = np.array([float(x or 0) for x in row])
    report |= {"after": after.tolist(), "residual": (after - goal).tolist(), "iterations": len(steps), "met": met}
    (LOG.info if met else LOG.warning)("mixing: %s", report)
    return rate_column(steps, place, max_rate), report


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None, max_train: int = MAX_TRAIN, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per document: doc_id, n_tokens, domain (the likeliest), posterior (by domain), rate."""
    post, domains = posteriors(docs, labelled, max_train)
    rate, _ = fit_rates(post, domains, targets, budget, max_rate=max_rate)
    names = F.array(*[F.lit(d) for d in domains])
    best = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    # a column of its own first: below, posterior is the name of the map
    rated = post.withColumn("rate", rate)
    return rated.select("doc_id", "n_tokens", best.alias("domain"), F.map_from_arrays(names, "posterior").alias("posterior"), "rate")


def copies_of(rate: Column, doc_id: Column, seed: int = 17) -> Column:
    """The whole part of the rate, and one more with the probability of its fraction, by a hash of the id."""
    u = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None, max_train: int = MAX_TRAIN, max_rate: float = MAX_RATE) -> DataFrame:
    """The documents, each as often as its rate says; columns as they were.

    The documents are stored with their posteriors, so no row is looked up by its id and no text is shuffled.
    """
    model = fit(labelled_sample(docs, labelled, max_train))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    at = {c: n for c, n in zip(docs.columns, names)}
    post = stored(plain.mapInArrow(_posteriors(shared, at["text"]), f"{schema}, n_tokens long, posterior array<double>"), "posteriors")
    rate, _ = fit_rates(post, model.domains, targets, budget, max_rate=max_rate)
    rows = post.withColumn("copies", copies_of(rate, F.col(at["doc_id"]))).filter("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(n).alias(c) for c, n in at.items()])
