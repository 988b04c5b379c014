"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

A text becomes lower-cased words without punctuation, in which numbers, names and units are typed slots that keep
their value: a number is a word that starts with a digit (punctuation before it aside), a unit is a word of the unit
list after a number, a name is a word of a capital and small letters that does not start a sentence (words all in
capitals are words, so a shouted copy is still found). The template of a text has the
slots' types in place of their values, so a re-parameterised question has the template of the question.

Windows of ``width`` template words are hash-joined with the windows of the benchmark that have at least
``min_literals`` words that are no slots. On each alignment (document, item, offset) the slot values that meet must be
consistent: each value of the item stands for one value of the document, and the reverse. An item leaks into a
document if the windows of consistent alignments cover at least ``coverage`` of its windows. Items shorter than a
window are searched as a whole, by windows of their own length, down to ``min_literals`` words. Items of which no window
has enough literals (arithmetic, lists of numbers and names) are searched as they stand: all their words, values included,
in a row, which counts as one window of one. Only items below EDITED_WIDTH words are not searched: ``unsearched`` gives them.

With ``edited``, edited copies are searched besides, without slots: windows of
EDITED_WIDTH lower-cased words are joined, and the item's words that they cover are counted in a band of offsets as wide
as half the item. An item leaks if EDITED_COVERAGE of its words are covered (EDITED_WORDS at least, or all of a shorter
item), or if EDITED_RUN words follow each other unchanged. So a few changed, added or left-out words, another case of
letters, and excerpts of EDITED_RUN words hide nothing.
Items below EDITED_WIDTH words are not searched this way. The row of a leak that only this search finds has the covered
words and the item's words as windows and item_windows, and no n_slots.

Each document row makes its windows alone, and only windows that meet the benchmark are shuffled. The benchmark's
windows are broadcast while they are at most BROADCAST_WINDOWS rows, counted first; beyond it the join shuffles. Words
are hashed once, and windows are hashed and looked up by compiled code; a broadcast join reads slots of matches alone.

Defined cases: null and empty texts have no window; rows of one doc_id are judged together, as are rows without one;
repeated rows count once; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, stored

BROADCAST_WINDOWS = 200_000
LEAKED_KEYS = 1_000_000
WIDTH, MIN_LITERALS, COVERAGE = 8, 5, 0.5
EDITED_WIDTH, EDITED_COVERAGE, EDITED_WORDS, EDITED_RUN = 4, 0.5, 8, 13
#: The narrowest band of offsets, in words.
BAND = 16
_S = r"\x20\x09-\x0D"
# Units of measure, as words after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs day days week weeks month months year years hour hours "
    "minute minutes second seconds meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams "
    "kilogram kilograms pound pounds ounce ounces liter liters litre litres percent degree degrees dollar dollars euro euros cent cents"
).split()
#: (pattern, replacement with $n): numbers, names (twice, as neighbours share the space), units; then punctuation goes.
STEPS = (
    (rf"(^|[{_S}])([^{_S}\p{{L}}\p{{N}}]*\p{{N}}[^{_S}]*)", "$1\x01n$2"),
    (rf"([^{_S}.!?:;\"'\x01][{_S}]+)(\p{{Lu}}\p{{Ll}}\p{{L}}*)", "$1\x01p$2"),
    (rf"([^{_S}.!?:;\"'\x01][{_S}]+)(\p{{Lu}}\p{{Ll}}\p{{L}}*)", "$1\x01p$2"),
    (rf"(\x01n[^{_S}]*[{_S}]+)({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})([^\p{{L}}\p{{N}}]|$)", "$1\x01u$2$3"),
)
#: STEPS for Java and texts that start with a space: a match takes the space before a slot alone, so neighbouring names need
#: one step. ``\\s`` is ``[_S]`` there.
_JAVA_STEPS = (
    (r"\s(?=[^\s\p{L}\p{N}]*+\p{N})", "$0\x01n"),
    ("\\s(?=\\s*+\\p{Lu}\\p{Ll})(?<=[^\\s.!?:;\"'\x01]\\s)\\s*+", "$0\x01p"),
    STEPS[-1],
)
_PUNCTUATION = rf"[^\p{{L}}\p{{N}}\x01{_S}]+"


def template_words(text: Column) -> Column:
    """Words of a text; a slot is ``\\x01``, its type (n, p, u) and its value."""
    out = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    for pattern, put in _JAVA_STEPS:
        out = F.regexp_replace(out, pattern, put)
    return _split(out)


def _split(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x01\s]+", ""), r"\s+"), "")


def _template(words: Column) -> Column:
    """The hash of each template word."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w.startswith("\x01"), F.substring(w, 1, 2)).otherwise(w)))


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """The rows once for each window of their word hashes ``t``: ``pos`` is its place, ``h`` its hash."""
    # compiled as a whole: functions over elements are interpreted. Not a column is exploded, as Spark would filter it by its size and compute it twice
    at = F.when(F.size("t") >= width, F.sequence(F.lit(0), F.size("t") - width))
    return rows.withColumn("pos", F.explode(at)).withColumn("h", F.xxhash64(*[F.get("t", F.col("pos") + k) for k in range(width)])).drop("t")


def _slots(width: int) -> Column:
    """The slots' values, in order, of the window at ``pos`` of ``w``."""
    # compiled with the windows: between compiled stages each window's row would hold the words of its whole text
    word = [F.get("w", F.col("pos") + k) for k in range(width)]
    return F.array_remove(F.array(*[F.when(w.startswith("\x01"), w).otherwise("") for w in word]), "")


def _literals(slots: Column, width: int) -> Column:
    return width - F.size(slots)


def template_matches(words: DataFrame, rows: DataFrame, width: int, small_side: bool) -> DataFrame:
    """(doc_id, item_id, offset, ipos, slots, islots): windows of ``words`` (doc_id, w) that are in ``rows`` of ``benchmark_windows``."""
    found = _windows(words.withColumn("t", _template(F.col("w"))), width)
    if small_side:  # slots of matches alone
        found = found.join(F.broadcast(rows), "h").withColumn("slots", _slots(width))
    else:
        found = found.select("doc_id", "pos", "h", _slots(width).alias("slots")).join(rows, "h")
    return found.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("offset"), "ipos", "slots", "islots")


def benchmark_windows(benchmark: DataFrame, width: int, min_literals: int, item_col: str = "item_id", text_col: str = "text") -> dict[int, DataFrame]:
    """Informative windows (item_id, ipos, h, islots) by width: ``width``, and the lengths of shorter items."""
    items = stored(benchmark.select(F.col(item_col).alias("item_id"), template_words(F.col(text_col)).alias("w")), "items")
    lengths = [r[0] for r in items.select(F.size("w").alias("n")).filter((F.col("n") >= min_literals) & (F.col("n") < width)).distinct().collect()]
    out = {}
    for k in [width, *sorted(lengths)]:
        of = items.filter(F.size("w") >= width) if k == width else items.filter(F.size("w") == k)
        rows = _windows(of.withColumn("t", _template(F.col("w"))), k).select("item_id", F.col("pos").alias("ipos"), "h", _slots(k).alias("islots"))
        out[k] = rows.filter(_literals(F.col("islots"), k) >= min_literals)
    return out


def _conflicts(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Alignments in which a value of ``one`` stands for several of ``other``."""
    key = ["doc_id", "item_id", "offset"]
    return pairs.groupBy(*key, one).agg((F.min(other) != F.max(other)).alias("several")).filter("several").select(*key).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_literals: int = MIN_LITERALS, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", edited: bool = False) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, n_slots): each item that leaks into a document, with ``edited`` edited copies too."""
    words = docs.select(F.col(id_col).alias("doc_id"), template_words(F.col(text_col)).alias("w"))
    matches = totals = None
    for k, rows in benchmark_windows(benchmark, width, min_literals).items():
        rows = stored(rows, "benchmark-windows")
        if (n := rows.count()) == 0 and k != width:
            continue
        total = rows.groupBy("item_id").agg(F.countDistinct("ipos").alias("item_windows"))
        found = template_matches(words, rows, k, n <= BROADCAST_WINDOWS)
        matches = found if matches is None else matches.unionByName(found)
        totals = total if totals is None else totals.unionByName(total)
    matches = stored(matches, "window-matches")
    pairs = matches.filter("size(slots) > 0").select("doc_id", "item_id", "offset", F.explode(F.arrays_zip("slots", "islots")).alias("p")).select("doc_id", "item_id", "offset", "p.slots", "p.islots").distinct()
    bad = _conflicts(pairs, "islots", "slots").unionByName(_conflicts(pairs, "slots", "islots")).withColumns({"b_doc": F.col("doc_id"), "b_item": F.col("item_id"), "b_offset": F.col("offset")}).select("b_doc", "b_item", "b_offset")
    same = F.col("doc_id").eqNullSafe(F.col("b_doc")) & F.col("item_id").eqNullSafe(F.col("b_item")) & (F.col("offset") == F.col("b_offset"))
    good = matches.join(bad, same, "left_anti")
    covered = good.groupBy("doc_id", "item_id").agg(F.countDistinct("ipos").alias("windows"), F.max(F.size("slots")).cast("long").alias("n_slots"))
    totals = totals.withColumnRenamed("item_id", "t_item")
    joined = covered.join(F.broadcast(totals) if totals.count() <= BROADCAST_WINDOWS else totals, F.col("item_id").eqNullSafe(F.col("t_item")))
    out = joined.filter(F.col("windows") >= coverage * F.col("item_windows")).select("doc_id", "item_id", "windows", "item_windows", "n_slots")
    bare = benchmark.select(F.col("item_id"), F.col("text"), template_words(F.col("text")).alias("t"))
    bare = bare.join(totals.select("t_item"), F.col("item_id").eqNullSafe(F.col("t_item")), "left_anti")
    bare = stored(bare.select("item_id", plain_words(F.col("text")).alias("w"), F.size(F.filter("t", lambda x: x.startswith("\x01"))).cast("long").alias("n_slots")).filter(F.size("w") >= EDITED_WIDTH), "bare-items")
    if bare.limit(1).count():
        whole = _plain_alignments(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bare).filter(F.size("at") == F.col("n_words") - (EDITED_WIDTH - 1))
        slots = bare.groupBy(F.col("item_id").alias("s_item")).agg(F.max("n_slots").alias("n_slots"))
        whole = whole.select("doc_id", "item_id").distinct().join(slots, F.col("item_id").eqNullSafe(F.col("s_item")))
        out = out.unionByName(whole.select("doc_id", "item_id", F.lit(1).cast("long").alias("windows"), F.lit(1).cast("long").alias("item_windows"), "n_slots"))
    if edited:
        out = stored(out, "template-leaks")
        known = out.select(F.col("doc_id").alias("t_doc"), F.col("item_id").alias("t_item"))
        more = edited_leaks(docs, benchmark, id_col=id_col, text_col=text_col)
        more = more.join(known, F.col("doc_id").eqNullSafe(F.col("t_doc")) & F.col("item_id").eqNullSafe(F.col("t_item")), "left_anti")
        out = out.unionByName(more.select("doc_id", "item_id", F.col("covered").cast("long").alias("windows"), F.col("n_words").cast("long").alias("item_windows"), F.lit(None).cast("long").alias("n_slots")))
    return out


def plain_words(text: Column) -> Column:
    """Lower-cased words of a text without punctuation, values and names as they stand."""
    return _split(F.coalesce(text, F.lit("")))


def _plain(words: Column) -> Column:
    """The hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _plain_alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, offset, at): the sorted places in the item of the windows that a document has at an offset.

    ``docs`` has (doc_id, text), ``items`` (item_id, w).
    """
    rows = _windows(items.select("item_id", F.size("w").alias("n_words"), _plain(F.col("w")).alias("t")), EDITED_WIDTH)
    rows = stored(rows.select("item_id", "n_words", F.col("pos").alias("ipos"), "h"), "benchmark-plain-windows")
    found = _windows(docs.select("doc_id", _plain(plain_words(F.col("text"))).alias("t")), EDITED_WIDTH)
    found = found.join(F.broadcast(rows) if rows.count() <= BROADCAST_WINDOWS else rows, "h").select("doc_id", "item_id", "n_words", (F.col("pos") - F.col("ipos")).alias("offset"), "ipos")
    return found.groupBy("doc_id", "item_id", "n_words", "offset").agg(F.array_sort(F.collect_set("ipos")).alias("at"))


def unsearched(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n_words) of the items that are too short to be searched at all."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.size(plain_words(F.col(text_col))).alias("n_words"))
    return items.filter(F.col("n_words") < EDITED_WIDTH)


def _longest_run(at: Column) -> Column:
    """The most consecutive numbers in a sorted array."""

    def step(state: Column, x: Column) -> Column:
        run = F.when(x == state["last"] + 1, state["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(at, F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda s: s["best"])


def edited_leaks(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, covered, run): each item of which a document has enough words in order, or a long excerpt."""
    items = stored(benchmark.select(F.col(item_col).alias("item_id"), plain_words(F.col(text_col)).alias("w")).distinct(), "plain-items")
    found = _plain_alignments(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items)
    words = F.flatten(F.transform("at", lambda p: F.sequence(p, p + (EDITED_WIDTH - 1))))
    band = F.greatest(F.lit(BAND), F.floor(F.col("n_words") / 2).cast("int"))
    # bands overlap by half, so offsets that differ by half a band meet in one
    bands = F.array(F.floor(F.col("offset") / band) * 2, F.floor((F.col("offset") + F.floor(band / 2)) / band) * 2 + 1)
    found = found.select("doc_id", "item_id", "n_words", words.alias("words"), (_longest_run(F.col("at")) + (EDITED_WIDTH - 1)).alias("run"), F.explode(bands).alias("band"))
    found = found.groupBy("doc_id", "item_id", "n_words", "band").agg(F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("covered"), F.max("run").alias("run"))
    found = found.groupBy("doc_id", "item_id", "n_words").agg(F.max("covered").alias("covered"), F.max("run").alias("run"))
    enough = F.least(F.col("n_words"), F.greatest(F.lit(EDITED_WORDS), F.ceil(F.col("n_words") * EDITED_COVERAGE)))
    return found.filter((F.col("covered") >= enough) | (F.col("run") >= EDITED_RUN))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without leaks; columns as they were. Texts are judged, by a key of each, so rows that share an id or have none go only with their own text."""
    key, leaked = fresh("text_key", docs.columns), fresh("leaked_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = stored(leaks(keyed, benchmark, id_col=key, **options).select(F.col("doc_id").alias(leaked)).distinct(), "leaked-keys")
    # a few in a hundred documents leak; the list is broadcast while it is at most LEAKED_KEYS (8 bytes each)
    return keyed.join(small(found, found.count(), LEAKED_KEYS), F.col(key) == F.col(leaked), "left_anti").select(*docs.columns)


def _canon_sql(column: str) -> str:
    out = f"coalesce({column}, '')"
    quoted = lambda s: s.replace("'", "''")
    for pattern, put in STEPS:
        duck = put.replace("$1", r"\1").replace("$2", r"\2").replace("$3", r"\3")
        out = f"regexp_replace({out}, '{quoted(pattern)}', '{quoted(duck)}', 'g')"
    return f"list_filter(string_split_regex(regexp_replace(lower({out}), '{quoted(_PUNCTUATION)}', '', 'g'), '[{_S}]+'), lambda x: x <> '')"


def _windows_sql(name: str, source: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT {key}, i - 1 AS pos, list_transform(w[i:i + {WIDTH - 1}], lambda x: CASE WHEN x[1] = chr(1) THEN x[1:2] ELSE x END) AS t,
         list_filter(w[i:i + {WIDTH - 1}], lambda x: x[1] = chr(1)) AS slots
  FROM (SELECT {key}, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM {source} WHERE len(w) >= {WIDTH}))"""


SQL = f"""
WITH d AS (SELECT doc_id, {_canon_sql("text")} AS w FROM documents),
b AS (SELECT item_id, {_canon_sql("text")} AS w FROM benchmark),
{_windows_sql("dw", "d", "doc_id")},
{_windows_sql("bw", "b", "item_id")},
bi AS (SELECT * FROM bw WHERE {WIDTH} - len(slots) >= {MIN_LITERALS}),
totals AS (SELECT item_id, count(DISTINCT pos) AS item_windows FROM bi GROUP BY item_id),
matches AS (
  SELECT doc_id, item_id, dw.pos - bi.pos AS shift, bi.pos AS ipos, dw.slots AS slots, bi.slots AS islots FROM dw JOIN bi ON dw.t = bi.t),
pairs AS (SELECT DISTINCT doc_id, item_id, shift, unnest(slots) AS s, unnest(islots) AS i FROM matches),
bad AS (
  SELECT doc_id, item_id, shift FROM pairs GROUP BY doc_id, item_id, shift, i HAVING count(DISTINCT s) > 1
  UNION SELECT doc_id, item_id, shift FROM pairs GROUP BY doc_id, item_id, shift, s HAVING count(DISTINCT i) > 1),
covered AS (
  SELECT doc_id, item_id, count(DISTINCT ipos) AS windows, max(len(slots)) AS n_slots
  FROM matches ANTI JOIN bad USING (doc_id, item_id, shift) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, windows, item_windows, n_slots FROM covered JOIN totals USING (item_id) WHERE windows >= {COVERAGE} * item_windows
"""
