"""The pipeline's stages against plain versions of what each must do."""

import re

import numpy as np
import pytest

import corpus_pipeline
from pointmill.llm import bpe, decontam, mixing, quality_classifier
from pointmill.llm.features import places
from tests.llm.test_contracts import EDGE, SCHEMA, plain_near

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def plain_words(text):
    """Words without punctuation, lower-cased."""
    return [w for w in (re.sub(r"[^\w]|_", "", w) for w in (text or "").lower().split()) if w]


def test_stages(spark):
    """Each stage on what the one before it kept; near duplicates are texts alike in four of five 5-word shingles, or in all but 4 bits."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [plain_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF)
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == columns
        if name == "mixing to target weights":
            model = mixing.fit(mixing.labelled_sample(docs, mixing.labelled_domains(docs, labels), mixing.MAX_TRAIN))
            goal = {d: s for d, s in mixing.TARGETS.items() if d in model.domains and d != "low"}
            had, has = (sum(len((r[1] or "").split()) * model.posterior(places(r[1])[0]) for r in x) for x in (before, rows))
            share = lambda t: np.array([t[model.domains.index(d)] for d in goal]) / sum(t[model.domains.index(d)] for d in goal)
            aim = np.array(list(goal.values())) / sum(goal.values())
            assert np.abs(share(has) - aim).max() < max(0.05, 0.5 * np.abs(share(had) - aim).max())
            assert set(rows) <= set(before)
        else:
            # what stays is as it was, and nothing stays more often than it was there
            assert all(rows.count(r) <= before.count(r) for r in rows)
        if name == "quality classifier":
            model = quality_classifier.fit_from(docs, quality_classifier.graded(labels), 3)
            assert {r[0] for r in rows} == {r[0] for r in before if model.tails(places(r[1])[0])[1] >= quality_classifier.KEEP_PROBABILITY}
        if name == "simhash near-dedup":
            assert sorted(r[0] for r in rows) == sorted({c for _, c in plain_near(before)})
        if name == "benchmark decontamination":
            assert decontam.leaks(out, spark.read.parquet(f"{SF}/benchmark.parquet"), edited=True).count() == 0
            kept = {r[0] for r in rows}
            for r in before:
                w = " " + " ".join(plain_words(r[1])) + " "
                if any(f" {' '.join(item)} " in w for item in items):
                    assert r[0] not in kept
                elif not any(f" {' '.join(item[k : k + 4])} " in w for item in items for k in range(len(item) - 3)):
                    assert r[0] in kept
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert counts[0] > counts[1] > counts[2] > 0
    last = STAGES["token ids"](spark, docs, SF).orderBy("start").collect()
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in docs.collect())
    encoder, at = bpe.PieceEncoder(bpe.load(bpe.default_path())), 0
    sizes = sorted((r.doc_id, len(encoder.encode(r.text)) // 4 + 1) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in last) == sizes
    for r in last:
        assert r.start == at
        at += r.n_tokens


def test_rows_without_ids(spark):
    """Rows are judged by their own texts: one that shares its id with a leak or a copy, or has none, stays if its text is clean."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, item, "en", "a", 1), (None, "a clean text of nobody", "en", "a", 1), (3, item, "en", "a", 1), (3, "another clean text of id three", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = sorted((tuple(r) for r in STAGES["benchmark decontamination"](spark, docs, SF).collect()), key=repr)
    assert kept == sorted([rows[1], rows[3]], key=repr)
    kept = sorted((tuple(r) for r in STAGES["simhash near-dedup"](spark, docs, SF).collect()), key=repr)
    assert kept == sorted([rows[1], rows[2], rows[3]], key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_defined_cases(spark, name):
    """Nulls, blank and long texts, repeated rows, clashing columns and an empty table."""
    edge = spark.createDataFrame(EDGE, SCHEMA)
    clashing = edge
    for c in ("fp", "text_key", "gone_id", "leaked_key", "copies", "posterior", "n_tokens", "c0"):
        clashing = clashing.withColumn(c, edge.n_chars)
    for docs in (edge, clashing):
        out = STAGES[name](spark, docs, SF)
        assert name == "token ids" or out.columns == docs.columns
        # rates have no bound, so how often the mixing stage repeats so few documents has none either
        assert out.count() <= len(EDGE) if name != "mixing to target weights" else {r.doc_id for r in out.collect()} <= {r[0] for r in EDGE}
    assert STAGES[name](spark, edge.limit(0), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
