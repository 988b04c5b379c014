"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to ``ORDERS``-grams of code points (A-Z and a-z alike), hashed to 2^BITS places: relative
frequency in the whole text times the inverse document frequency over all training documents. Weights come from
follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties over a bounded sample of labelled documents
(``max_train``, shared out evenly among languages), in about STEPS steps whatever its size; a part of the sample is held back to fit the temperature that
calibrates probabilities. Document frequencies cover every training document.

The sample's features reach the driver as sparse counts, at most ``max_train`` rows of at most 2^BITS entries; the
document frequencies as one array per partition, summed in steps. Texts never do.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 (``und`` also where nothing was learnt);
documents with a null doc_id or null lang are not trained on; a null doc_id is in no fold, so held_out is false;
repeated rows are predicted each; of languages with equal scores the first by name is predicted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

BITS, ORDERS = 15, 3
MAX_TRAIN = 4_000
FOLDS = 5
#: Code points hashed at once.
_CHUNK = 3_000_000
#: Steps of the regression, at every size of the sample.
STEPS = 12_000
# Odd multipliers of the n-gram hash.
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def has_letter(text: str | None) -> bool:
    """A code point of the categories L; superscripts, fractions and Roman numerals are none."""
    return bool(text) and any(map(str.isalpha, text))


def _code_points(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    upper = (c >= 65) & (c <= 90)
    return np.where(upper, c + 32, c).astype(np.uint32)


def ngram_places(c: np.ndarray) -> list[np.ndarray]:
    """For each order, the place of the n-gram that ends at each code point from the order's first full one on."""
    out, h = [], np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        for n in range(ORDERS):
            if len(c) <= n:
                break
            h = c * _MULTIPLIERS[0] if n == 0 else (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MULTIPLIERS[1] + c[n:] * _MULTIPLIERS[2]
            out.append(((h ^ (h >> np.uint32(13))) * _MULTIPLIERS[1] >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _counts(text: str) -> np.ndarray:
    """Occurrences of every place in the whole text, in chunks that overlap by ORDERS - 1 code points."""
    total = np.zeros(1 << BITS, np.int64)
    c = _code_points(text)
    for at in range(0, len(c), _CHUNK):
        lead = min(at, ORDERS - 1)
        for n, places in enumerate(ngram_places(c[at - lead : at + _CHUNK])):
            total += np.bincount(places[max(0, lead - n) :], minlength=1 << BITS)
    return total


# ---- statistics and training sample -----------------------------------------------------------------------------


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    df, docs = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            if has_letter(t := text.as_py()):
                seen = np.zeros(1 << BITS, bool)
                for places in ngram_places(_code_points(t)):
                    seen[places] = True
                df += seen
                docs += 1
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([docs], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["slot", "docs", "df"])


_DF = "slot int, docs long, df binary"


def _add(key, t):
    df = np.zeros(1 << BITS, np.int64)
    for x in t.column("df"):
        df += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "docs": pa.array([sum(t.column("docs").to_pylist())], pa.int64()), "df": pa.array([df.tobytes()], pa.binary())})


def inverse_frequencies(training: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequencies over all training documents; at most 16 arrays reach the driver."""
    df, docs = np.zeros(1 << BITS, np.int64), 0
    for r in training.select("text").mapInArrow(_document_frequencies, _DF).groupBy("slot").applyInArrow(_add, _DF).toLocalIterator():
        df += np.frombuffer(bytes(r["df"]), np.int64)
        docs += r["docs"]
    return (np.log((1 + docs) / (1 + df)) + 1).astype(np.float32)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            total = _counts(batch.column("text")[i].as_py())
            at = np.flatnonzero(total)
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([row.column("h"), row.column("lang"), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([total[at].astype("<u4").tobytes()], pa.binary())], ["h", "lang", "places", "counts"])


def training_sample(training: DataFrame, max_train: int) -> list:
    """Sparse counts of at most ``max_train`` documents, languages in even shares; the choice is by a hash of doc_id."""
    some = training.filter(F.col("text").rlike(r"\p{L}"))
    per = {r["lang"]: r["count"] for r in some.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_train).collect()}
    if not per:
        return []
    quota = max(1, max_train // len(per))
    share = F.lit(0.0)
    for lang, n in per.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, quota / n))).otherwise(share)
    h = F.xxhash64("doc_id")
    chosen = some.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).select("h", "lang", "text")
    rows = chosen.mapInArrow(_sparse, "h long, lang string, places binary, counts binary").orderBy("h", "lang").limit(max_train).collect()
    return [(r["h"], r["lang"], np.frombuffer(bytes(r["places"]), "<u4").astype(np.int64), np.frombuffer(bytes(r["counts"]), "<u4").astype(np.float32)) for r in rows]


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # idf times weight, by place and language
    bias: np.ndarray
    temperature: float


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal per coordinate and class over (places, values, class); the last coordinate is the bias."""
    bias = 1 << BITS
    z, n = np.zeros((bias + 1, classes), np.float32), np.zeros((bias + 1, classes), np.float32)
    penalty = np.full((bias + 1, 1), l1, np.float32)
    penalty[bias] = 0

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= penalty[at], 0, -(zi - np.sign(zi) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)).astype(np.float32)

    rng = np.random.default_rng(11)
    passes = max(1, round(steps / max(1, len(rows))))
    for _ in range(passes):
        for k in rng.permutation(len(rows)).tolist():
            places, values, y = rows[k]
            at, x = np.append(places, bias), np.append(values, np.float32(1))
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(np.arange(bias + 1))
    return w[:bias], w[bias]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by a search over a grid that is refined once."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
    best = grid[int(np.argmin([loss(t) for t in grid]))]
    grid = best * np.exp(np.linspace(-0.1, 0.1, 21))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def fit(training: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel:
    """``training``: doc_id, text, lang, all with labels."""
    rows = training_sample(training, max_train)
    langs = sorted({r[1] for r in rows})
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    idf = inverse_frequencies(training)
    made = [(places, counts / counts.sum() * idf[places], langs.index(lang)) for _, lang, places, counts in rows]
    # one scale for all documents, by which their mean length is 1
    scale = np.float32(1 / np.mean([np.linalg.norm(v) for _, v, _ in made]))
    made = [(places, values * scale, y) for places, values, y in made]
    held = [k for k in range(len(made)) if k % 5 == 4]
    w, bias = ftrl([made[k] for k in range(len(made)) if k % 5 != 4], len(langs))
    logits = np.array([made[k][1] @ w[made[k][0]] + bias for k in held]).reshape(len(held), len(langs))
    return LanguageModel(langs, (w * (scale * idf)[:, None]).astype(np.float32), bias, fit_temperature(logits, np.array([made[k][2] for k in held], np.int64)))


# ---- prediction -------------------------------------------------------------------------------------------------


def logits_of(text: str, model: LanguageModel) -> np.ndarray:
    """Logits of a whole text: sums over n-grams, by chunks."""
    total, n = np.zeros(len(model.langs)), 0
    c = _code_points(text)
    for at in range(0, len(c), _CHUNK):
        lead = min(at, ORDERS - 1)
        for k, places in enumerate(ngram_places(c[at - lead : at + _CHUNK])):
            places = places[max(0, lead - k) :]
            n += len(places)
            if len(places) > 4096:
                total += np.bincount(places, minlength=1 << BITS).astype(np.float32) @ model.table
            else:
                total += model.table[places].sum(axis=0, dtype=np.float64)
    return total / n + model.bias


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text"):
                t = text.as_py()
                if not model.langs or not has_letter(t):
                    pred.append("und")
                    score.append(0.0)
                    continue
                s = logits_of(t, model) / model.temperature
                p = np.exp(s - s.max())
                k = int(np.argmax(p))
                pred.append(model.langs[k])
                score.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = FOLDS, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns from the folds but 0, predicts from text alone."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)))
    training = rows.filter("doc_id IS NOT NULL AND NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(fit(training, max_train))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")
