"""Each operator against a plain version on a small table, and its defined edge cases."""

import math
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pointmill.llm import bpe, decontam, features, langid, lm_scoring, mixing, quality_classifier, quality_rules, simhash, token_counts, token_output, url_filters
from pointmill.llm import queries as llm
from tests.compare import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


EDGE = [
    (1, None, "en", None, None),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", "a", 3),
    (4, "One two three four five six seven eight nine ten.", "en", "a", 10),
    (4, "One two three four five six seven eight nine ten.", "en", "a", 10),
    (None, "One two three four five six seven eight nine ten.", "en", "b", 10),
    (7, "word " * 30_000, "en", "b", 150_000),
    (8, "a  b\n\n c \x0b d é<|endoftext|>中文 &&& 12 km", "fr", "b", 1),
    (9, "12 | 34 | 56", None, None, None),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def clashing(edge):
    """Extra columns with names that operators use themselves."""
    out = edge
    for name in ("fp", "digest", "content", "h", "word", "row", "rate", "copies", "leaked_id", "held_out", "label", "n_tokens", "component_id", "root", "tails", "c0"):
        out = out.withColumn(name, F.lit(7))
    return out


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    assert spark_rows(llm.queries()[name](spark, SF)) == duck_rows(duck(SF), llm.oracle_sql()[name])


# ---- tokens -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_the_library(tokenizer, docs):
    encoder = bpe.PieceEncoder(bpe.load(bpe.default_path()), max_pieces=500)
    rng = np.random.default_rng(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "<|endoftext|>", "&&", "\x1c", "\xa0", "中", ".", "!", "<", "|>", "\r", "cd", " x"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)] + [r.text for r in docs.limit(100).collect()]
    for at in range(0, len(texts), 37):
        for text, got in zip(texts[at : at + 37], encoder.encode_many(texts[at : at + 37])):
            assert np.frombuffer(got, "<u4").tolist() == ids_of(tokenizer, text), repr(text)


def test_words_equal_the_library(tokenizer):
    """Letters of any script, marks, digits and signs inside words, first and later in a text, and the spelling of every byte."""
    encoder = bpe.PieceEncoder(bpe.load(bpe.default_path()))
    words = ["straße", "žluťoučký", "слово", "语言模型", "ﬁn", "e\u0301te", "ªº", "a²b", "Ⅷ", "𐐀𐐁", "naïve", "x\u00adx", "l'été", "ab1c", "ʼn", "हिन्दी", "\u0378"]
    words += [chr(c) for c in range(33, 1000) if not chr(c).isspace()] + [f"a{chr(c)}b" for c in range(33, 1000) if not chr(c).isspace()]
    for text in ([" ".join(words)], words, [f"x {w}, {w}" for w in words], [f"x\n{w} {w}" for w in words]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(text)] == [ids_of(tokenizer, x) for x in text]


def test_pieces_of_odd_columns(tokenizer):
    """Columns without a piece, long runs of punctuation, lines of all kinds, and a memory that is full at every call."""
    encoder = bpe.PieceEncoder(bpe.load(bpe.default_path()), max_pieces=3)
    words = ["ab", "ab.", "ab" + "." * 8, "ab" + "!?" * 5, "12.", "ª.", "é!", "\u0378.", "...", "x1.", "a's.", "<.", "a<b.", "\tq.", "\u3000z.", "\x85"]
    lines = [f"{a}\n{b}" for a in words for b in ["", *words]] + ["\n", "\n\n", "a\n\nb", "\na", "'s\n's"]
    for texts in ([], [None], ["", None], ["ab"], ["ab "], [" "], words, lines, [f"x {w} {w}" for w in words + lines], [" ".join(words + lines)]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(texts)] == [ids_of(tokenizer, x) for x in texts]
        column = pa.array(["left out", *texts], pa.string()).slice(1)
        assert encoder.count_column(column).tolist() == [len(ids_of(tokenizer, x)) for x in texts]
        sizes, ids = encoder.encode_column(column, 2)
        assert sizes.tolist() == [len(ids_of(tokenizer, x)) + 1 for x in texts] and ids.to_pylist() == [i for x in texts for i in [*ids_of(tokenizer, x), 2]]
    assert len(encoder.known) <= 1000


def test_pieces_are_no_objects():
    """What is remembered of many words is columns, not objects of Python's for each."""
    encoder, rng = bpe.PieceEncoder(bpe.load(bpe.default_path())), np.random.default_rng(2)
    text = pa.array([" ".join("".join(w) + t for w, t in zip(rng.choice(list("abcdefgh"), (20_000, 7)), rng.choice(["", ".", ","], 20_000)))])
    encoder.encode_column(pa.array(["a b, c."]))
    before = sys.getallocatedblocks()
    sizes, ids = encoder.encode_column(text)
    assert len(ids) == sizes[0] > 20_000 and sys.getallocatedblocks() - before < 5_000


def test_token_counts(spark, edge, empty, clashing, tokenizer, tmp_path):
    want = sorted(((d, len((t or "").encode()), len(ids_of(tokenizer, t)), len(ids_of(tokenizer, t)) > 5) for d, t, *_ in EDGE), key=repr)
    cache = f"file://{tmp_path}/cache"
    count = lambda df: sorted((tuple(r) for r in token_counts.token_counts(df, bpe.default_path(), cache, limit=5).collect()), key=repr)
    assert count(edge) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, *_ in EDGE})
    # a second run, and one with clashing columns, find every digest in the cache
    assert count(clashing) == want and spark.read.parquet(cache).count() == stored
    assert count(empty) == []


def test_token_files(spark, edge, empty, clashing, tokenizer, tmp_path):
    def plain(rows):
        at, out = 0, []
        for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = [*ids_of(tokenizer, t), 2]
            out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        return out

    for k, df in enumerate((edge, clashing, empty)):
        token_output.write_token_ids(df, path := f"file://{tmp_path}/ids{k}", bpe.default_path(), end_id=2, files=3)
        assert sorted((tuple(r) for r in token_output.token_spans(spark, path).collect()), key=repr) == sorted(plain(EDGE if k < 2 else []), key=repr)
    found = token_output.find_documents(spark, f"file://{tmp_path}/ids0", [4, 8])
    assert sorted(r.doc_id for r in found.collect()) == [4, 4, 8]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    assert {r.doc_id: list(r.ids) for r in found.collect()}[8] == [*ids_of(tokenizer, EDGE[7][1]), 2]


# ---- SimHash ------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def components_of_rows(rows):
    comp = plain_components([plain_fingerprint(t) for _, t, *_ in rows])
    least = {}
    for c, (d, *_) in zip(comp, rows):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(((d, format(plain_fingerprint(t), "016x"), least.get(c)) for c, (d, t, *_) in zip(comp, rows)), key=repr)


def test_simhash(spark, edge, empty, clashing, docs):
    run = lambda df: sorted((tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert run(edge) == run(clashing) == components_of_rows(EDGE)
    assert run(empty) == []
    assert run(docs) == components_of_rows([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("cell_rows", [40_000, 60])
def test_simhash_links(spark, monkeypatch, cell_rows):
    """Clusters and chains around random points, in whole cells and in cells dealt as chunks."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(simhash, "BLOCK_CELLS", 3000)
    rng = np.random.default_rng(4)
    prints = {int(x) for x in rng.integers(0, 2**63, 150)}
    for start in list(prints)[:6]:
        x = start
        for _ in range(40):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)], "fp long, id long")
    roots = {r.node: r.root for r in simhash.components(simhash.link_forest(df, len(prints))).collect()}
    got = [roots.get(int(np.uint64(p).astype(np.int64)), int(np.uint64(p).astype(np.int64))) for p in prints]
    want = plain_components(prints)
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_one_of_each(spark, edge):
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    comp = components_of_rows(EDGE)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in comp})


def test_one_of_each_without_ids(spark):
    rows = [(None, "alone and without an id at all"), (None, "alone and without an id at all"), (None, "a text that has an id elsewhere"), (5, "a text that has an id elsewhere"), (5, "a text that has an id elsewhere")]
    kept = simhash.one_of_each(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int"))
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == [(5, rows[3][1], 1), (None, rows[0][1], 1)]


def plain_near(rows, similarity=0.8, width=5):
    """Components of 4-bit links and of all pairs of shingle sets at least so similar."""
    sets, least = [], {}
    for _, t, *_ in rows:
        w = [lower(x) for x in WORD.findall(t or "")]
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    comp = plain_components([plain_fingerprint(t) for _, t, *_ in rows])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    for c, (d, *_) in zip(comp, rows):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    return sorted(((d, least[c]) for c, (d, *_) in zip(comp, rows)), key=repr)


@pytest.mark.parametrize("sample", [64, 1])
def test_similar(spark, monkeypatch, docs, edge, empty, sample):
    """Near copies beyond the fingerprints' distance, against all pairs by brute force, for any order of shingles."""
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    run = lambda df: sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df, similarity=0.8).collect()), key=repr)
    rows = [tuple(r) for r in docs.collect()]
    assert run(docs) == plain_near(rows) and {(145, 6), (177, 1)} <= set(run(docs))
    assert run(edge) == plain_near(EDGE) and run(empty) == []
    kept = {r.doc_id for r in simhash.one_of_each(docs, similarity=0.8).collect()}
    assert kept == {c for _, c in plain_near(rows)} and {145, 177}.isdisjoint(kept)


# ---- quality rules, URL filters ------------------------------------------------------------------------------------


def test_quality_rules(spark, edge, empty, clashing):
    def plain(t):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        again = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)

    for df, rows in ((edge, EDGE), (clashing, EDGE), (empty, [])):
        got = quality_rules.quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((d, *plain(t)) for d, t, *_ in rows), key=repr)
    assert quality_rules.quality_rules(edge).filter("kept AND base_failed").count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.net", "HTTP://X.Example.NET/en/1", "https://example.com/de/?q#f", "https://badexample.com/de/", "http://u.org/fr/x", "http://h.co.uk/p?x://y", "ftp://h.co.uk#f", "http://spam.org/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://spam.org/2", None)] + [(100 + i, "http://spam.org/p", "") for i in range(60)] + [(200 + i, f"http://good{i}.com/p", "") for i in range(90)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(90)] + [(8, 0), (None, 1), (3, None)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(pages, labels).collect()}
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None) and got[0][3] == "allow"
    assert got[3] == ("a.net", "", None, "allow")
    assert got[4] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5] == ("example.com", "/de/", "example.com/de/", "block") and got[6][2] is None
    assert got[7] == ("u.org", "/fr/x", "org/fr/", "allow")
    assert got[8][:2] == ("h.co.uk", "/p") and got[9][:2] == ("h.co.uk", "")
    assert got[10][3] == got[None][3] == "block"
    assert url_filters.url_filter(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_filters.url_filter(pages.filter("page_id = 10"), labels.limit(0)).collect()} == {"allow"}


def test_domains(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.y.com",), ("com",), ("",)], "h string")
    assert [tuple(r) for r in hosts.select(url_filters.domain_of(F.col("h")), url_filters.suffix_of(F.col("h"))).collect()] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "uk"), ("y.com", "com"), ("com", "com"), ("", "")]


# ---- decontamination ----------------------------------------------------------------------------------------------

ITEM = "A farmer named Tom has 12 cows and buys 30 more; how many cows does Tom own after selling 5 of the 12 cows at 40 km from home?"


def test_leaks(spark, empty):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "whole item of exactly seven words here")], "item_id long, text string")
    swapped = ITEM.replace("Tom", "Ann").replace("12", "17").replace("30", "99")
    broken = ITEM.replace("named Tom", "named Ann").replace("has 12", "has 17")
    rows = [
        (1, f"Before it. {ITEM} After it."),
        (2, f"Some words first, then. {swapped} And more."),
        (3, f"Some words first, then. {broken} And more."),
        (4, "Quite another text about cows and farmers that has nothing to do with it at all."),
        (5, None),
        (6, ""),
        (7, "He wrote: whole item of exactly seven words here, so it leaks"),
        (None, ITEM),
        (1, f"Before it. {ITEM} After it."),
        (8, "5 6 7 8 9 10 11 12 13 14 " * 3000 + ITEM.upper()),
    ]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, item_id int, offset int, leaked_id int")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert found == {(1, 1), (2, 1), (7, 4), (None, 1)}
    assert [r.doc_id for r in decontam.clean(docs, bench).orderBy("doc_id").collect()] == [3, 4, 5, 6, 8]
    assert decontam.leaks(empty, bench).count() == decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == len(rows)


def test_leaks_without_literals(spark):
    """Items of few literal words leak where they stand with their own values; what cannot be searched is told."""
    many = "Add 1 and 2 and 3 then 4 5 6 7 8 and 9 10 11 12 13 14 15 16 17 18"
    items = [(1, "What is 12 times 7?"), (2, "Compute 3 + 4 * 5 - 6 / 2"), (3, many), (4, "too short"), (5, None), (None, "Is 5 more than 3?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "He asked: what is 12 times 7? Nobody knew."), (2, "Now compute 3 + 4 * 5 - 6 / 2 by hand"), (3, f"Here: {many}."), (4, "is 5 more than 3?"),
            (5, "what is 13 times 7"), (6, "compute 3 + 4 * 5 - 6 / 3"), (7, many.replace("10", "99")), (8, "too short"), (9, "12 times 7 what is"), (None, "what is 12 times 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {(1, 1), (2, 2), (3, 3), (4, None), (None, 1)}
    assert {r.item_id for r in decontam.unsearched(bench).collect()} == {4, 5}


def test_edited_leaks(spark):
    """Shouted, lower-cased and title-case copies, 5 % edited ones and a short excerpt are removed from the corpus."""
    rng = np.random.default_rng(2)
    texts = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")

    def edit(words):
        out = list(words)
        for i in rng.choice(len(out), max(1, round(len(out) * 0.05)), replace=False):
            out[i] = "edited"
        return out

    copies = []
    for text in texts:
        w = text.split()
        dropped = [x for i, x in enumerate(w) if i != len(w) // 2]
        copies += [text.upper(), text.lower(), text.title(), " ".join(edit(w)), " ".join(dropped), " ".join(w[1:14])]
    clean_words = "a plain document that shares what is the of and with nothing else in here".split()
    rows = [(i, f"Before it all. {t} After it all.", 1) for i, t in enumerate(copies)] + [(-1, " ".join(clean_words * 30), 1), (-2, None, 1), (-3, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    assert {r.doc_id for r in decontam.clean(docs, bench, edited=True).collect()} == {-1, -2, -3}
    assert decontam.edited_leaks(docs, bench.limit(0)).count() == decontam.edited_leaks(docs.limit(0), bench).count() == 0


def test_template_words(spark):
    """Words and slots are those of STEPS, one step after the other, as the SQL has them."""
    rng = np.random.default_rng(5)
    atoms = ["\n", "\t ", "\x0b", "\x85", "Tom", "Ann", "tOm", "NASA", "Ünal", "Ǆ", "Σας", "ΣΑΣ", "a", "B", "Bc", "5", "3.5", "$7", "(8)", "Ⅷ", "km", "min", "kg.", "Km", ".", "?", ":", "'", "…", "\x01", "\x01n", "😀", "𐐀𐐨", "É", "B2b", "2Bc"]
    texts = [None, "", " ", "5 km", "\n5 km\n", "a Bc De Fg Hi Jk", "a  Bc\n De", "Bar. Baz", "x\x01 Baz", "😀 Baz", "a 5 km 6 m 7"]
    texts += ["".join(a + rng.choice(["", " ", " "]) for a in rng.choice(atoms, 12)) for _ in range(3000)]
    plain = F.coalesce(F.col("text"), F.lit(""))
    for pattern, put in decontam.STEPS:
        plain = F.regexp_replace(plain, pattern, put)
    plain = F.filter(F.split(F.regexp_replace(F.lower(plain), decontam._PUNCTUATION, ""), f"[{decontam._S}]+"), lambda w: w != "")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", plain.alias("want"), decontam.template_words(F.col("text")).alias("got")).collect()
    assert len(rows) == len(texts) and [r for r in rows if r.want != r.got] == []
    assert {w[:2] for r in rows for w in r.got if w[0] == "\x01"} >= {"\x01n", "\x01p", "\x01u"}


def test_windows_are_compiled(spark, monkeypatch):
    """Windows are made, hashed and looked up in one compiled stage, of which no row holds the words of its text."""
    plans, stored = {}, decontam.stored

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(decontam, "stored", seen)
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        decontam.leaks(docs, bench, edited=True)
        plans["edited"] = decontam.edited_leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for label in ("window-matches", "edited"):
        lines = [x.lstrip(" :+-") for x in plans[label].splitlines()]
        join = next(x for x in lines if "BroadcastHashJoin [h#" in x)
        stage = join.split(" ")[0]
        assert stage.startswith("*(") and [x for x in lines if "Generate explode(CASE" in x and x.startswith(stage)]
        assert [x for x in lines if "lambda" in x and x.startswith(stage)] == []
    assert plans["window-matches"].startswith("*")


def test_leaks_of_long_texts(spark, monkeypatch):
    """A text of many copies of an item: its windows do not each take the whole text along, with either join."""
    copies = 1500
    bench = spark.createDataFrame([(1, ITEM), (2, "whole item of exactly eight quite plain words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Here: {ITEM} " * copies), (2, "nothing of it " * 20000)], "doc_id long, text string")
    want = [(r.item_id, r.windows, r.item_windows, r.n_slots) for r in decontam.leaks(docs.limit(0).unionByName(spark.createDataFrame([(1, f"Here: {ITEM} Here: {ITEM}")], docs.schema)), bench).collect()]
    for limit in (decontam.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
        assert [(r.doc_id, r.item_id, r.windows, r.item_windows, r.n_slots) for r in decontam.leaks(docs, bench).collect()] == [(1, *x) for x in want] != []


# ---- language, quality, mixing --------------------------------------------------------------------------------------


def test_language(spark, docs, edge, empty, clashing):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 20 and np.mean([r.lang_pred == r.lang for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    for df in (edge, clashing):
        out = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(df).collect()), key=repr)
        assert [p for d, p in out if d in (1, 2, 3, 9)] == ["und"] * 4 and len(out) == len(EDGE)
    assert langid.identify(empty).count() == 0
    # no label can steer a prediction of the held-out fold
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert {r.lang_pred for r in langid.identify(other).collect()} == {r.lang_pred for r in got}


def test_ngrams_cross_chunks(monkeypatch):
    text = "The quick brown fox, über alles. " * 20
    whole = langid._counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 7)
    assert (langid._counts(text) == whole).all()


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 2, 10 + int(rng.integers(500))]), np.ones(2, np.float32), k % 2) for k in range(400)]
    w, _ = langid.ftrl(rows, 2, l1=3.0)
    assert w[0].any() and w[1].any() and (w[10:] == 0).all()


def test_temperature():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits / 2)
    y = np.array([rng.choice(3, p=q / q.sum()) for q in p])
    assert langid.fit_temperature(logits, y) == pytest.approx(2, rel=0.2)


def test_quality_classifier(spark, docs, edge, empty, clashing):
    labels = quality_classifier.graded(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = labels.filter("doc_id % 4 <> 0")
    got = quality_classifier.quality_scores(big, train).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    good, bad = [r for r in got if r.label == 2], [r for r in got if r.label != 2]
    assert np.mean([r.kept for r in good]) > 0.9 and np.mean([r.expected_grade for r in good]) > np.mean([r.expected_grade for r in bad])
    assert all(r.tails[0] >= r.tails[1] and abs(sum(r.tails) - r.expected_grade) < 1e-9 for r in got)
    for df in (edge, clashing):
        assert quality_classifier.quality_scores(df, labels).count() == len(EDGE)
        assert quality_classifier.select_quality(df, labels).columns == df.columns
        assert quality_classifier.select_quality(df, labels.limit(0)).count() == len(EDGE)
    assert quality_classifier.quality_scores(empty, labels).count() == 0


def test_cumulative_link():
    rng = np.random.default_rng(6)
    x = rng.normal(size=1500)
    rows = [np.array([0 if v < -1 else 1 if v < 0 else 2 if v < 1 else 3, features.WORDS]) for v in x]
    grades = np.digitize(x + 0.1 * rng.normal(size=1500), [-1, 1])
    m = quality_classifier.fit(rows, grades, 3, l1=1e-5)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[0] < m.weights[1] < m.weights[3]
    assert m.tails(rows[0]).shape == (2,)


def test_mixing(spark, docs, edge, empty, clashing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    post, domains = mixing.posteriors(docs, mixing.labelled_domains(docs, labels))
    rate, report = mixing.fit_rates(post, domains, mixing.TARGETS)
    rows = post.select("n_tokens", "posterior", rate.alias("rate")).collect()
    pick = [domains.index(d) for d in report["domains"]]
    after = sum(r.rate * r.n_tokens * np.array(r.posterior)[pick] for r in rows)
    assert min(r.rate for r in rows) >= 0 and after == pytest.approx(np.array(report["after"]))
    n = sum(r.n_tokens for r in rows)
    assert np.abs(after - np.array(report["target"])).max() < 0.03 * n
    # against the same iteration over a plain matrix
    a = np.array([[r.n_tokens * p for p in np.array(r.posterior)[pick]] for r in rows]).T
    r = np.ones(len(rows))
    d = np.array([1 / x.n_tokens if x.n_tokens else 0 for x in rows])
    gram = (a * d) @ a.T
    m = np.linalg.inv(gram + mixing.RIDGE * np.trace(gram) / len(pick) * np.eye(len(pick)))
    for _ in range(mixing.ITERATIONS):
        if np.abs(a @ r - report["target"]).max() <= 1e-4 * n:
            break
        r = np.where(d > 0, np.clip(r - d * (a.T @ (m @ (a @ r - np.array(report["target"])))), 0, mixing.MAX_RATE), 1.0)
    assert [x.rate for x in rows] == pytest.approx(r.tolist(), abs=1e-6)
    for df in (edge, clashing):
        assert mixing.mixing_rates(df, mixing.labelled_domains(df, labels)).count() == len(EDGE)
        assert mixing.mixed(df, mixing.labelled_domains(df, labels)).columns == df.columns
    lone = mixing.mixing_rates(edge, mixing.labelled_domains(edge, labels.limit(0))).collect()
    assert {r.domain for r in lone} == {"all"} and all(r.rate == pytest.approx(1) for r in lone)
    assert mixing.mixing_rates(empty, mixing.labelled_domains(empty, labels)).count() == 0


@pytest.mark.parametrize("max_rate", [mixing.MAX_RATE, 4.0])
def test_scarce_domains(spark, max_rate):
    """A domain far below its target is pulled to it, or under a bound as near as rates up to the bound bring it."""
    rows = [(100, [0.98, 0.02])] * 990 + [(100, [0.02, 0.98])] * 10
    post = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    rate, report = mixing.fit_rates(post, ["a", "b"], {"a": 0.7, "b": 0.3}, max_rate=max_rate)
    rates = {round(r.posterior[1], 2): r.rate for r in post.select("posterior", rate.alias("rate")).collect()}
    assert report["domains"] == ["a", "b"] and report["target"] == pytest.approx([70_000, 30_000])
    assert np.array(report["after"]) - np.array(report["target"]) == pytest.approx(np.array(report["residual"]))
    if max_rate == 4.0:
        assert rates[0.98] == pytest.approx(4.0) and report["residual"][1] < 0
    else:
        assert rates[0.98] > 4 and np.abs(report["residual"]).max() <= 1e-4 * 100_000


def test_copies(spark):
    c = spark.range(4000).select(mixing.copies_of(F.lit(1.25), F.col("id")).alias("c")).groupBy("c").count().collect()
    n = {r.c: r["count"] for r in c}
    assert set(n) == {1, 2} and n[2] == pytest.approx(1000, rel=0.15)


# ---- language model -------------------------------------------------------------------------------------------------


def plain_base(rows):
    tokens = [[*WORD.findall(lower(t)), None] for _, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows]
    c = Counter(w for (d, *_), t, h in zip(rows, tokens, held) if d is not None and not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((d, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)) for (d, *_), t, h in zip(rows, tokens, held)), key=repr)


@pytest.mark.parametrize("known", [150_000, 30])
def test_lm_base(spark, monkeypatch, docs, edge, clashing, known):
    """Counts and base scores, with all tokens known to the scorer and with most of them joined."""
    real = lm_scoring.vocabulary
    monkeypatch.setattr(lm_scoring, "vocabulary", lambda t, **k: real(t, known=known, head=20 if known == 30 else 768))
    for df, rows in ((edge, EDGE), (clashing, EDGE), (docs.limit(60), None)):
        if rows is None:
            rows = [tuple(r) for r in df.collect()]
            df = spark.createDataFrame(rows, SCHEMA)
        got = lm_scoring.lm_scores(df, warm_docs=20).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == plain_base(rows)
        assert all(r.score < 0 for r in got)


def test_lm_learns(spark, docs, empty):
    got = lm_scoring.lm_scores(docs).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_scoring.lm_scores(empty).count() == 0


def tiny_vocabulary():
    words = [lm_scoring.END, *(w.encode() for w in "the of and to in is it on as at by or an".split())]
    counts = np.arange(len(words), 0, -1) * 10
    classes = np.array([lm_scoring.tail_class(w) for w in words])
    mass = np.log10(np.bincount(classes[8:], counts[8:] + 0.1, minlength=lm_scoring.TAIL_CLASSES) + 0.1)
    return lm_scoring.Vocabulary(int(counts.sum()), len(words), {w: i for i, w in enumerate(words)}, counts, classes, mass, 8)


@pytest.mark.parametrize("with_end", [True, False])
def test_lm_encode(monkeypatch, with_end):
    """Places, classes and rare tokens of a column against words taken one by one, over the borders of slices."""
    monkeypatch.setattr(lm_scoring, "ENCODE_BYTES", 40)
    v = tiny_vocabulary()
    if not with_end:
        v.known = {w: i for i, w in enumerate(["zz".encode(), *list(v.known)[1:]])}
    texts = [t for _, t, *_ in EDGE if t is None or len(t) < 1000] + ["THE of\x1c and\x85to \x0b\x0c in\xa0 \x00 É A\u2003b", "the\tof\r\nAND", "x"]
    got = lm_scoring.encode(pa.array(["left out", *texts], pa.string()).slice(1), v)
    words = [[*(w.encode() for w in WORD.findall(lower(t))), lm_scoring.END] for t in texts]
    flat = [w for own in words for w in own]
    assert got.sizes.tolist() == [len(w) for w in words] and got.place.tolist() == [v.known.get(w, -1) for w in flat]
    assert got.tails.tolist() == [v.classes[v.known[w]] if w in v.known else lm_scoring.tail_class(w) for w in flat]
    assert got.rare.to_pylist() == [[w for w in own if w not in v.known] for own in words]


def test_lm_count_time(docs):
    """Tokens are counted without an object for each: in less time than words in a Counter take."""
    texts = [r.text for r in docs.collect()] * 10
    batches = pa.table({"text": texts}).to_batches()

    def plain():
        counts = Counter()
        for t in texts:
            counts.update((t or "").encode().lower().split())
            counts[lm_scoring.END] += 1
        return counts

    def ours():
        return list(lm_scoring._count(iter(batches)))

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    assert sum((Counter(dict(zip(*(c.to_pylist() for c in b.columns)))) for b in ours()), Counter()) == plain()
    assert min(seconds(ours) for _ in range(5)) < 0.75 * min(seconds(plain) for _ in range(5))


@pytest.mark.parametrize("size", [1, 3000])
def test_lm_output(size):
    """Log probabilities and gradients over several chunks of rows against one softmax, beyond the clip too."""
    v, rng = tiny_vocabulary(), np.random.default_rng(5)
    net = lm_scoring.Network(v.head)
    net.p = {k: p.astype(np.float64) for k, p in net.p.items()}
    net.p["C"][:, 3] *= 400
    h = rng.uniform(-1, 1, (size, lm_scoring.HIDDEN))
    cls, place = rng.integers(0, net.classes, size), np.full(size, -1)
    place[cls < 8] = 0
    e = np.exp(np.clip(h @ net.p["C"] + net.p["c"], -60, 60))
    e /= e.sum(axis=1, keepdims=True)
    logp, dh, grads = net.output(h, cls, place, grad=True)
    assert logp == pytest.approx(np.log(e[np.arange(size), cls]), abs=1e-9)  # one token a head class: its place is sure
    e[np.arange(size), cls] -= 1
    assert grads["C"] == pytest.approx(h.T @ e, abs=1e-6) and grads["c"] == pytest.approx(e.sum(axis=0), abs=1e-6)
    assert dh == pytest.approx(e @ net.p["C"].T, abs=1e-6)


def test_lm_state_crosses_windows(monkeypatch):
    """Scores do not depend on the window, nor on what else is in the batch."""
    v = tiny_vocabulary()
    net = lm_scoring.Network(v.head)
    texts = ["the of and " * 40, "to in is rare", None, "it"]
    whole = lm_scoring.score(net, v, texts)[3]
    monkeypatch.setattr(lm_scoring, "WINDOW", 5)
    assert lm_scoring.score(net, v, texts)[3] == pytest.approx(whole, rel=1e-4)
    assert [lm_scoring.score(net, v, [t])[3][0] for t in texts] == pytest.approx(whole.tolist(), rel=1e-4)


def test_lm_sums_to_one():
    v = tiny_vocabulary()
    net = lm_scoring.Network(v.head)
    h = np.random.default_rng(0).normal(size=(1, lm_scoring.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.output(h, np.array([i // net.size]), np.array([i % net.size]))[0][0]) for i in range(v.head))
    total += sum(np.exp(net.output(h, np.array([lm_scoring.HEAD_CLASSES + k]), np.array([-1]))[0][0]) for k in range(lm_scoring.TAIL_CLASSES))
    empty_classes = sum(np.exp(net.output(h, np.array([k]), np.array([-1]))[0][0]) for k in range(-(-v.head // net.size), lm_scoring.HEAD_CLASSES))
    assert total + empty_classes == pytest.approx(1, abs=1e-4)


def test_lm_gradient():
    """Backpropagation against differences."""
    v = tiny_vocabulary()
    net = lm_scoring.Network(v.head)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(3)
    x, keep = rng.integers(0, 10, (6, 2)), np.ones((6, 2, 1))
    keep[3, 1] = 0
    cls, place = rng.integers(0, 8, 12), np.zeros(12, np.int64)

    def loss():
        f = net.forward(x, keep, np.zeros((2, lm_scoring.HIDDEN)))
        return f, net.output(f["hs"][1:].reshape(-1, lm_scoring.HIDDEN).astype(np.float64), cls, place, grad=True)

    f, (_, dh, grads) = loss()
    grads |= net.backward(f, dh.reshape(6, 2, -1))
    for name, at in (("U", (3, 5)), ("N", (2, 7)), ("E", (int(x[0, 0]), 4)), ("C", (1, 2)), ("W", (int(cls[0]), 3, 0))):
        kept, e = net.p[name][at], 1e-2
        net.p[name][at] = kept + e
        up = -loss()[1][0].sum()
        net.p[name][at] = kept - e
        down = -loss()[1][0].sum()
        net.p[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-3, rel=0.05)
