"""Hashed-text features of whole documents, and bounded samples of labelled rows, for the linear models.

A document's features are the distinct places (crc32 of the word, 2^BITS of them) of its lower-cased words without
punctuation at their ends, and a few shape features that say how much of the text repeats, shouts, or is symbols,
each as one of eight steps. Values are 1, so a word counts however long the document is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
WORDS = 1 << BITS
SHAPES, STEPS = 8, 8
SIZE = WORDS + SHAPES * STEPS
_EDGE = b".,;:!?\"'()[]{}#*$%&|<>-_/\\"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
#: Upper ends of a share's steps.
_ENDS = np.array([0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])


def shape(text: str, words: list[bytes]) -> np.ndarray:
    """Places of the shape features."""
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = np.array(
        [
            len(_SYMBOL.findall(text)) / n,
            text.count("!") / n,
            len(_UPPER.findall(text)) / max(1, len(text)),
            sum(a == b for a, b in zip(words, words[1:])) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            1 - len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2) if len(words) > 2 else 0.0,
            len(_DIGIT.findall(text)) / max(1, len(text)),
            min(1.0, len(lines) / n),
        ]
    )
    return WORDS + np.arange(SHAPES) * STEPS + np.searchsorted(_ENDS, shares, side="left")


def places(text: str | None) -> tuple[np.ndarray, int]:
    """Distinct feature places of a whole text, ascending, and its number of words."""
    if not text:
        return np.zeros(0, np.int64), 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64), 0
    hashed = np.fromiter([crc32(w.strip(_EDGE)) for w in words], np.int64, len(words)) & (WORDS - 1)
    return np.concatenate((np.unique(hashed), shape(text, words))), len(words)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            at, _ = places(batch.column("text")[i].as_py())
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([row.column("h"), row.column("label"), pa.array([at.astype("<u4").tobytes()], pa.binary())], ["h", "label", "places"])


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, even: bool = False, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, np.ndarray]]:
    """(label, places) of at most ``max_rows`` labelled documents, chosen by a hash of their id.

    ``labels`` has (doc_id, label). With ``even``, labels get even shares. The chosen ids are a bounded list, so they
    are broadcast; features are made on the executors.
    """
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("label").cast("string")).alias("label"))
    h = F.xxhash64("doc_id")
    share = F.lit(min(1.0, max_rows / max(1, 0 if even else known.count())))
    if even:
        per = {r["label"]: r["count"] for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_rows).collect()}
        quota = max(1, max_rows // max(1, len(per)))
        share = F.lit(0.0)
        for label, n in per.items():
            share = F.when(F.col("label") == label, F.lit(min(1.0, quota / n))).otherwise(share)
    # the share leaves about max_rows of them, so the ordered limit after it sees no more than that, however many there are
    known = known.filter(F.pmod(h, F.lit(1 << 30)) < share * (1 << 30))
    chosen = known.withColumn("h", h).orderBy("h", "doc_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("h", "label", "text")
    made = rows.mapInArrow(_featurise, "h long, label string, places binary").orderBy("h", "places").limit(max_rows).collect()
    return [(r["label"], np.frombuffer(bytes(r["places"]), "<u4").astype(np.int64)) for r in made]


class Rows:
    """Sparse rows of ones, for sums by row and by place."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows

    def batch(self, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, row within the batch) of the taken rows."""
        parts = [self.rows[k] for k in take.tolist()]
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def shrink(w: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
    """Soft threshold in place."""
    v = w[at]
    w[at] = np.sign(v) * np.maximum(np.abs(v) - by, 0)
