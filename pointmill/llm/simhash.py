"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint of 64 bits is embedded as the bit counts of 32 segments of two bits. Two fingerprints that differ in
k bits have embeddings at a Manhattan distance of k at most, so the distance is a lower bound of what is searched.
The embedding is kept in unary (a count of 0, 1, 2 as bits 00, 01, 11), in which the Manhattan distance is the bit
count of an exclusive or.

The grid: the 32 segments are dealt to B blocks. Of a Manhattan distance up to 4, at least B - 4 blocks have no
part, so both points lie in the same cell of one of the C(B, 4) grids that each keep B - 4 blocks. Each grid is one
exact cover of the range, for any B; B only trades the number of grids for the size of cells, and follows the number
of distinct fingerprints. Within a cell, the Manhattan distance over all segments filters pairs, and the bits
themselves decide.

Cells above ``CELL_ROWS`` rows are dealt as pairs of chunks, so no task holds more than two chunks, and none is cut.
Inside a cell no list of pairs is made: a union-find over blocks of rows gives the links of a spanning forest, which
joins the same documents as all links. Components over all cells come from alternating star contractions, as joins
and aggregates whose state is written to the shared folder after each round.

With ``similarity``, documents whose sets of shingles of ``similar_width`` words have a Jaccard similarity of at least
that much are linked as well, however many bits they differ in. Candidates come from an exact prefix join: of two such
sets ordered alike, the first n - ceil(similarity * n) + 1 shingles of each share one. Any order is exact; shingles that
a sample shows to be common come last. Prefixes are shuffled once, as packed arrays. In each bucket of a shingle, first
the least member is compared with the others, then those that no link joins yet with each other. A candidate is dropped
if the segment counts of its two sets (how many shingles fall into each of SKETCH segments) are further apart in
Manhattan distance than sets so similar can be, a lower bound again; what is left is verified on the sets themselves.

Defined cases: null or empty text has fingerprint zero and is linked like any other; a null doc_id gets its row, and
the least non-null id of its component; repeated rows each get their row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, sliced, small, stored, words_of

BITS = 64
SEGMENTS = 32
#: Rows of a cell, or of a chunk of it, that one task compares.
CELL_ROWS = 40_000
#: Comparisons held at once, one byte and some each.
BLOCK_CELLS = 2_000_000
#: One in so many texts tells which shingles are common, and the most of them that are held.
SAMPLE, COMMON = 64, 100_000
#: Segments of a set's counts, a byte each.
SKETCH = 256
#: Prefix entries that one group of the prefix join holds, about 24 bytes each.
ENTRIES = 1_000_000
#: Rows of ids, keys or fingerprints (two or three longs each) that may be broadcast, counted first.
BROADCAST_ROWS = 500_000
#: Chance that two unrelated fingerprints have equal counts in one segment: (1 + 4 + 1) / 16.
_EQUAL = 0.375


def shingles(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of all shingles in order, repeats included; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(line)][min(width, len(words)) - 1 :]
    return np.fromiter([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends)], np.uint64, len(ends))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all shingles, repeats included."""
    return majority(shingles(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter([fingerprint(t.as_py(), width, seed) for t in batch.column("text")], np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))], ["doc_id", "text_key", "fp"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a key of the text and the fingerprint as a signed long, for every row."""
    return _keyed(docs, id_col, text_col).mapInArrow(_fingerprints(width, seed), "doc_id long, text_key long, fp long")


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of two-bit segments in unary."""
    one, low = np.uint64(1), np.uint64(0x5555555555555555)
    return ((fp | (fp >> one)) & low) | ((fp & (fp >> one) & low) << one)


def grids(blocks: int, distance: int) -> list[int]:
    """A mask over the embedding for each grid: the blocks whose counts must be equal."""
    size = [SEGMENTS // blocks + (b < SEGMENTS % blocks) for b in range(blocks)]
    at = np.concatenate(([0], np.cumsum(size)))
    masks = [sum(3 << (2 * int(s)) for s in range(int(at[b]), int(at[b + 1]))) for b in range(blocks)]
    return [sum(masks[b] for b in kept) for kept in combinations(range(blocks), blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """The number of blocks with the least estimated work: rows in grids (about 2 us each) and pairs in cells (about 3 ns)."""

    def work(b: int) -> float:
        tables = comb(b, distance)
        return n * tables * 2e-6 + n * n / 2 * tables * _EQUAL ** (SEGMENTS * (b - distance) / b) * 3e-9

    return min(range(distance + 1, distance + 7), key=work)


def _cells(masks: list[int]):
    """Each fingerprint once per grid: (grid, cell, fp)."""
    keys = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            cells = unary_counts(fp)[:, None] & keys[None, :]
            grid = np.broadcast_to(np.arange(len(keys), dtype=np.int32), cells.shape)
            yield pa.RecordBatch.from_arrays([pa.array(grid.ravel()), pa.array(cells.ravel().view(np.int64)), pa.array(np.repeat(fp, len(keys)).view(np.int64))], ["grid", "cell", "fp"])

    return run


def forest(fp: np.ndarray, distance: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph of fingerprints at most ``distance`` bits apart.

    With ``other``, only pairs between the two lists are compared. Memory is bounded by BLOCK_CELLS; a link is kept
    only if it joins two trees.
    """
    points = fp if other is None else np.concatenate((fp, other))
    n, first = len(points), 0 if other is None else len(fp)
    rows = n if other is None else len(fp)
    embedded = unary_counts(points)
    label = np.arange(n)
    left: list[int] = []
    right: list[int] = []
    at = 0
    while at < rows:
        start = first if first else at
        step = max(1, BLOCK_CELLS // max(1, n - start))
        end = min(rows, at + step)
        # the Manhattan distance of the embeddings never exceeds the number of differing bits
        near = np.bitwise_count(embedded[at:end, None] ^ embedded[None, start:]) <= distance
        i, j = np.nonzero(near)
        i, j = i + at, j + start
        ok = (i < j) & (label[i] != label[j])
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(points[i] ^ points[j]) <= distance
        i, j = i[ok], j[ok]
        if len(i):
            # one link for each pair of trees is enough
            a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            _, one = np.unique(a * n + b, return_index=True)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (p := root.get(x, x)) != x:
                    root[x] = root.get(p, p)
                    x = p
                return x

            for k in one.tolist():
                x, y = find(int(a[k])), find(int(b[k]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    left.append(int(i[k]))
                    right.append(int(j[k]))
            moved = np.arange(n)
            for x in list(root):
                moved[x] = find(x)
            label = moved[label]
        at = end
    return points[np.array(left, np.int64)], points[np.array(right, np.int64)]


_EDGES = "u long, v long"


def _edges(distance: int):
    """Rows come sorted by (grid, cell, a, b, side); each run of one cell, or of one pair of its chunks, is compared."""

    def links(fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        one, two = fp[side == 0], fp[side == 1]
        u, v = forest(one, distance) if not len(two) else forest(one, distance, two)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("grid", "cell", "a", "b")], axis=1)
            fp, side = np.asarray(batch.column("fp")).view(np.uint64), np.asarray(batch.column("side"))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:]):
                this = tuple(key[s].tolist())
                if held and this != last:
                    yield links(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                held.append((fp[s:e], side[s:e]))
                last = this
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def link_forest(prints: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints that join the same ones as all links up to ``distance`` bits do."""
    masks = grids(blocks_for(n, distance), distance)
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cells = prints.select("fp").mapInArrow(_cells(masks), "grid int, cell long, fp long")
    # there are at most n * grids / CELL_ROWS cells so large
    large = cells.groupBy("grid", "cell").count().filter(F.col("count") > CELL_ROWS)
    large = stored(large.select("grid", "cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("chunks")), "large-cells")
    if (n_large := large.count()) == 0:
        dealt = cells.withColumns({"a": F.lit(0), "b": F.lit(0), "side": F.lit(0)})
    else:
        hinted = F.broadcast(large) if n_large <= 100_000 else large
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        chunked = cells.join(hinted, ["grid", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own)
        # chunk c meets every chunk: as the first of (c, x) with x >= c, as the second of (x, c) with x < c
        dealt = chunked.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
            "grid", "cell", "fp", F.least("own", "x").alias("a"), F.greatest("own", "x").alias("b"), F.when(F.col("own") <= F.col("x"), 0).otherwise(1).alias("side")
        )
    ordered = dealt.repartition(parts, "grid", "cell", "a", "b").sortWithinPartitions("grid", "cell", "a", "b", "side")
    edges = ordered.mapInArrow(_edges(distance), _EDGES).distinct()
    return edges


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each component, for every other node of an edge, by alternating stars.

    Each round is two joins and aggregates over the links left, which are no more than there were; its links are
    written to the shared folder. It ends when a round changes nothing; the number of rounds grows with the
    logarithm of the number of nodes.
    """
    now = stored(edges.filter("u <> v").select("u", "v").distinct(), "links")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every greater neighbour is linked to the least one
        wide = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        wide = stored(wide, "links")
        # small star: a node and its lesser neighbours are linked to the least of them; in these links v < u
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        narrow = wide.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = stored(narrow.filter("u <> v").distinct(), "links")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(wide)
        drop_stored(now)
        now, same, state = after, tuple(new) == tuple(state), new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingle_set(hashes: np.ndarray, steps: int) -> np.ndarray:
    """The distinct shingles that ``steps`` neighbouring hashes make, ascending; a text of fewer is one shingle.

    Two shingles of w words that follow each other are one of w + 1 words, so one hash of each text's words serves both widths.
    """
    if not len(hashes):
        return hashes
    steps = min(steps, len(hashes))
    n = len(hashes) - steps + 1
    out = hashes[:n]
    for k in range(1, steps):
        out = (out ^ (out >> np.uint64(31))) * _MIX[0] + hashes[k : k + n] * _MIX[1]
    return np.unique(out)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _digest(own: np.ndarray, seed: int) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(own.tobytes(), seed)).astype(np.int64))


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _sets(width: int, seed: int, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [shingle_set(shingles(t.as_py(), width, seed), steps) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x, seed) for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["digest", "members"])

    return run


_DESCRIBED = "doc_id long, text_key long, fp long, digest long, n int, sketch binary, prefix binary"


def _describe(width: int, seed: int, similarity: float, steps: int, shared):
    """Fingerprint; digest, size and segment counts of the set; its prefix in the order (sampled count, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = shared.value
        for batch in sliced(batches):
            prints, digests, sizes, sketches, prefixes = [], [], [], [], []
            for text in batch.column("text"):
                hashes = shingles(text.as_py(), width, seed)
                prints.append(majority(hashes))
                own = shingle_set(hashes, steps)
                digests.append(_digest(own, seed))
                sizes.append(len(own))
                sketches.append(np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8))
                keep = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
                if len(common) and len(own):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.lexsort((own, np.where(common[at] == own, times[at], 0)))]
                prefixes.append(own[:keep])
            out = [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()), _binary(sketches), _binary(prefixes)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "fp", "digest", "n", "sketch", "prefix"])

    return run


def _common_shingles(texts: DataFrame, width: int, seed: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of texts have, at most COMMON of them, and in how many."""
    sample = texts.filter(F.pmod("text_key", F.lit(SAMPLE)) == 0).select("text").distinct()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text"):
                own = shingle_set(shingles(t.as_py(), width, seed), steps)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["h"])

    rows = sample.mapInArrow(each, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    common, times = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(common)
    return common[order], times[order]


_PACKED = "part int, h binary, digest binary, n binary, pos binary"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, as most high bytes are zero and pack away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _pack(parts: int):
    """Prefix entries dealt to parts by their hash: a row for each part that a batch has entries of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, n = np.asarray(batch.column("digest")), np.asarray(batch.column("n"))
            _, first = np.unique(digest, return_index=True)
            own = [np.frombuffer(batch.column("prefix")[int(i)].as_py(), np.uint64) for i in first]
            sizes = np.array([len(x) for x in own], np.int64)
            if not sizes.sum():
                continue
            h, row = np.concatenate(own), np.repeat(first, sizes)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            part = (h % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
            at = [order[a:b] for a, b in zip(cuts, cuts[1:])]
            columns = [pa.array([part[i[0]] for i in at], pa.int32()), _binary([h[i] for i in at]), _binary([digest[row[i]] for i in at])]
            columns += [pa.array([_planes(x[i]) for i in at], pa.binary()) for x in (n[row], pos)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "h", "digest", "n", "pos"])

    return run


_SHARED = "h long, times int, leader long, l_n int, l_pos int, digest long, n int, pos int"


def _shared_entries(t: pa.Table) -> pa.Table:
    """Of the entries of a part, those whose hash several sets have, with the least of these sets as the leader."""
    join = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(c)])
    h, digest = join("h", np.uint64), join("digest", np.int64)
    n, pos = (np.concatenate([_from_planes(x.as_py()) for x in t.column(c)]) for c in ("n", "pos"))
    order = np.lexsort((digest, h))
    h, digest, n, pos = (x[order] for x in (h, digest, n, pos))
    # copies of a set that came in several batches are one
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (digest[1:] != digest[:-1])))
    h, digest, n, pos = (x[new] for x in (h, digest, n, pos))
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    sizes = np.diff(np.append(starts, len(h)))
    lead, times = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    keep = times > 1
    lead = lead[keep]
    ints = lambda x: pa.array(x.astype(np.int32))
    values = [pa.array(h[keep].view(np.int64)), ints(times[keep]), pa.array(digest[lead]), ints(n[lead]), ints(pos[lead]), pa.array(digest[keep]), ints(n[keep]), ints(pos[keep])]
    return pa.Table.from_arrays(values, ["h", "times", "leader", "l_n", "l_pos", "digest", "n", "pos"])


def _near_sketches(similarity: float):
    """Pairs whose segment counts are no further apart than sets so similar can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("a", "b"))
            apart = np.abs(a - b).sum(axis=1)
            # |A| + |B| - 2 |A and B| of sets with a similarity s is at most (1 - s) / (1 + s) of |A| + |B|
            ok = apart <= (1 - similarity) / (1 + similarity) * np.asarray(batch.column("sum")) + 1e-6
            yield batch.filter(pa.array(ok)).select(["one", "two"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float, width: int, seed: int, steps: int) -> DataFrame:
    """The pairs (one, two) of digests whose sets are similar enough, by the sets themselves."""
    pairs = stored(pairs.distinct(), "candidate-pairs")
    one, two = (sets.select(F.col("digest").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(c)) for name, c in (("one", "a"), ("two", "b")))
    rows = pairs.join(one, "one").join(two, "two").select("one", "two", "a", "b", (F.col("one_n") + F.col("two_n")).alias("sum"))
    near = stored(rows.mapInArrow(_near_sketches(similarity), "one long, two long"), "near-pairs")
    wanted = near.select(F.col("one").alias("digest")).union(near.select("two")).distinct()
    wanted = stored(wanted.join(sets.select("digest", "text_key"), "digest").select("text_key").distinct(), "wanted-texts")
    found = texts.join(small(wanted, wanted.count(), BROADCAST_ROWS), "text_key", "left_semi").select("text_key", "text").dropDuplicates(["text_key"])
    members = stored(found.select("text").mapInArrow(_sets(width, seed, steps), "digest long, members array<long>").dropDuplicates(["digest"]), "candidate-sets")
    one, two = (members.select(F.col("digest").alias(name), F.col("members").alias(c)) for name, c in (("one", "a"), ("two", "b")))
    # row by row in the JVM, as a batch of pairs of long sets has no bound
    both = F.size(F.array_intersect("a", "b"))
    joined = near.join(two, "two").join(one, "one").select("one", "two", both.alias("both"), (F.size("a") + F.size("b")).alias("sum"))
    out = stored(joined.filter(F.col("both") >= similarity * (F.col("sum") - F.col("both")) - 1e-9).select("one", "two"), "similar-pairs")
    for done in (pairs, near, wanted, members):
        drop_stored(done)
    return out


def similar_links(texts: DataFrame, described: DataFrame, links: DataFrame, similarity: float, width: int, seed: int, steps: int) -> DataFrame:
    """The links between fingerprints, with those of documents whose sets of shingles are similar enough.

    ``described`` has the rows of ``_describe``.
    """
    spark = described.sparkSession
    filled = described.filter("n > 0")
    sets = stored(filled.groupBy("digest").agg(F.min("fp").alias("least_fp"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "shingle-sets")
    equal = filled.select("digest", "fp").distinct().join(sets.select("digest", "least_fp"), "digest").filter("fp <> least_fp")
    links = stored(links.unionByName(equal.select(F.col("fp").alias("u"), F.col("least_fp").alias("v"))), "links-so-far")
    total = filled.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // ENTRIES + 1)
    packed = filled.select("digest", "n", "prefix").mapInArrow(_pack(parts), _PACKED)
    entries = stored(packed.groupBy("part").applyInArrow(_shared_entries, _SHARED), "shared-shingles")

    def may(two: str) -> Column:
        n, n2, pos, pos2 = F.col("n"), F.col(f"{two}n"), F.col("pos"), F.col(f"{two}pos")
        enough = (n + n2) * (similarity / (1 + similarity)) - 1e-9
        # what comes after a shared shingle bounds what the sets can share
        return (F.least(n, n2) >= similarity * F.greatest(n, n2) - 1e-9) & (1 + F.least(n - 1 - pos, n2 - 1 - pos2) >= enough)

    def with_links(found: DataFrame, links: DataFrame) -> DataFrame:
        fp = sets.select("digest", "least_fp")
        ends = found.join(fp.toDF("one", "u"), "one").join(fp.toDF("two", "v"), "two")
        return stored(links.unionByName(ends.select("u", "v")), "links-so-far")

    stars = entries.filter(F.col("digest") != F.col("leader")).filter(may("l_")).select(F.col("leader").alias("one"), F.col("digest").alias("two"))
    links = with_links(_similar(stars, sets, texts, similarity, width, seed, steps), links)
    # what is joined by now needs no comparison, nor does a bucket of two, nor one with a single component left
    roots = components(links)
    root = stored(sets.select("digest", "least_fp").join(roots, F.col("least_fp") == F.col("node"), "left").select("digest", F.coalesce("root", "least_fp").alias("root")), "roots-of-sets")
    rows = stored(entries.filter((F.col("times") > 2) & (F.col("digest") != F.col("leader"))).select("h", "digest", "n", "pos").join(root, "digest"), "open-shingles")
    drop_stored(entries)
    mixed = stored(rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("h"), "mixed-shingles")
    rows = rows.join(small(mixed, mixed.count(), BROADCAST_ROWS), "h", "left_semi")
    other = rows.select("h", *[F.col(c).alias(f"o_{c}") for c in ("digest", "root", "n", "pos")])
    rest = rows.join(other, "h").filter(F.col("digest") < F.col("o_digest")).filter((F.col("root") != F.col("o_root")) & may("o_"))
    return with_links(_similar(rest.select(F.col("digest").alias("one"), F.col("o_digest").alias("two")), sets, texts, similarity, width, seed, steps), links)


def _grouped(docs: DataFrame, distance: int, width: int, seed: int, id_col: str, text_col: str, similarity: float | None, similar_width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored frames: (doc_id, text_key, fp) of each row; (fp, least, first, times) of each fingerprint; (node, root) of the linked ones, roots included.

    ``first`` is the row that comes first: (no id, doc_id, text_key).
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("first")
    if similarity is None:
        prints = stored(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    else:
        if (steps := similar_width - width + 1) < 1:
            raise ValueError("shingles of a similarity are no shorter than those of the fingerprints")
        texts = _keyed(docs, id_col, text_col)
        shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(texts, width, seed, steps))
        described = stored(texts.mapInArrow(_describe(width, seed, similarity, steps, shared), _DESCRIBED), "described")
        prints = stored(described.select("doc_id", "text_key", "fp"), "fingerprints")
    own = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), first, F.count("*").alias("times")), "distinct-fingerprints")
    links = link_forest(own, own.count(), distance)
    if similarity is not None:
        links = similar_links(texts, described, links, similarity, width, seed, steps)
        drop_stored(described)
    roots = components(links)
    return prints, own, roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, similar_width: int = 5) -> DataFrame:
    """One row per document: doc_id, fp (signed long), fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    prints, own, roots = _grouped(docs, distance, width, seed, id_col, text_col, similarity, similar_width)
    linked = stored(own.join(roots, own.fp == roots.node).select("fp", "least", "root"), "linked-fingerprints")
    ids = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    of_linked = linked.join(small(ids, ids.count(), BROADCAST_ROWS), "root").select(F.col("fp").alias("l_fp"), "component_id")
    by_print = own.join(of_linked, F.col("fp") == F.col("l_fp"), "left").select("fp", F.when(F.col("l_fp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    by_print = stored(by_print, "component-of-fingerprint")
    return prints.join(by_print, "fp").select("doc_id", "fp", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 4, width: int = 4, similarity: float | None = None, similar_width: int = 5, seed: int = 42) -> DataFrame:
    """One document of each component, columns as they were: the one with the least doc_id (rows without one come last).

    Rows are told apart by (doc_id, text), so a row that shares its doc_id with a document of another component is judged
    by its own. Only the list of rows that go is joined with the texts, and broadcast while it is at most BROADCAST_ROWS.
    """
    prints, own, roots = _grouped(docs, distance, width, seed, "doc_id", "text", similarity, similar_width)
    linked = stored(own.join(roots, own.fp == roots.node).select("fp", "first", "root"), "linked-fingerprints")
    heads = stored(linked.groupBy("root").agg(F.min("first").alias("head")), "component-heads")
    of_linked = linked.join(small(heads, heads.count(), BROADCAST_ROWS), "root").select(F.col("fp").alias("l_fp"), "head")
    several = own.join(of_linked, F.col("fp") == F.col("l_fp"), "left").filter((F.col("times") > 1) | F.col("l_fp").isNotNull())
    several = stored(several.select(F.col("fp"), F.coalesce("head", "first").alias("head")), "shared-fingerprints")
    rows = prints.join(small(several, several.count(), BROADCAST_ROWS), "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    gone_id, gone_key, key = (fresh(name, docs.columns) for name in ("gone_id", "gone_key", "text_key"))
    named = [F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)]
    gone = stored(rows.filter(~stays).select(*named).distinct(), "rows-that-go")
    twice = stored(rows.filter(stays).groupBy("doc_id", "text_key").count().filter("count > 1").select(*named), "rows-that-repeat")
    listed = F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    out = docs.withColumn(key, F.xxhash64("text"))
    out = out.join(small(gone, gone.count(), BROADCAST_ROWS), listed, "left_anti")
    if n_twice := twice.count():
        twice = small(twice, n_twice, BROADCAST_ROWS)
        once = out.join(twice, listed, "left_semi").dropDuplicates(["doc_id", key])
        out = out.join(twice, listed, "left_anti").unionByName(once)
    for done in (prints, own, linked, heads, several):
        drop_stored(done)
    return out.select(*docs.columns)
