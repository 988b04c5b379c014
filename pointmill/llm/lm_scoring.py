"""Gated recurrent language model: counts over the corpus, data-parallel training, whole-document log-likelihood.

Tokens are lower-cased words and one end per document. Counts cover all training tokens. The output is factored into
classes: the ``HEAD`` most frequent tokens share ``HEAD_CLASSES`` classes of equal size with a softmax inside; every
other token belongs to one of ``TAIL_CLASSES`` classes by its last two bytes, with its smoothed relative count inside
the class (0.1 added, and 0.1 for the unseen). So each token, unseen ones included, has a probability, and the model
is one distribution over the base model's V + 1 symbols and their tail classes.

Training is truncated backpropagation in numpy over windows of ``WINDOW`` steps, state carried from window to window
and reset at document starts. A warm start runs in one task over a bounded number of training documents
(about ``warm_docs``); then every input partition passes over all its training documents from there, and the parameters are
averaged by tokens (local SGD), in two steps so that no task or driver holds more than a few dozen sets of them.

Scoring carries the state through whole documents. Tokens outside the ``KNOWN`` most frequent ones need their counts:
each document's list of them is stored with its row and joined with the count table by token, so the vocabulary is
never held in one place.

Defined cases: null text is empty, and scores its end token; a null doc_id has no fold, so it is neither held out nor
trained on; repeated rows are trained on and scored each; an empty table gives an empty result; without any training
token counts are zero and every score is that of an untrained model; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import give_back, slices, text_sizes
from .common import fold, stored

END = b"\n"
HEAD, HEAD_CLASSES, TAIL_CLASSES = 768, 24, 40
KNOWN = 150_000
HIDDEN, WINDOW, STREAMS = 16, 24, 512
#: Rows of a softmax over classes at once, so that its exponentials stay in a core's cache.
ROWS = 2_048
#: Tokens that are laid out in streams at once, about 40 bytes each. Scoring takes as many steps as its longest document
#: has tokens, so the more documents beside it the better.
SCORE_TOKENS, TRAIN_TOKENS = 3_000_000, 1_000_000
#: Texts turned into tokens at once.
ENCODE_BYTES = 8_000_000
#: Tokens counted before partial counts leave a task.
COUNT_TOKENS = 3_000_000
WARM_DOCS = 1_500
_CHARS = 4_000_000


def tail_class(word: bytes) -> int:
    """A class by the last two bytes."""
    return (word[-1] + 256 * (word[-2] if len(word) > 1 else 0)) % TAIL_CLASSES


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each word of a column."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    return (data[ends[1:] - 1] + 256 * np.where(np.diff(ends) > 1, data[ends[1:] - 2], 0).astype(np.int64)) % TAIL_CLASSES


# ---- counts -----------------------------------------------------------------------------------------------------


def word_column(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` each text of a column, in a row, and how many words each has (Arrow's functions for ASCII know no other space)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes, words = np.asarray(pc.list_value_length(split)).astype(np.int64), split.flatten().cast(pa.binary())
    full = np.asarray(pc.binary_length(words)) > 0
    if not full.all():  # beside white space at either end
        cuts = np.concatenate(([0], np.cumsum(full)))[np.concatenate(([0], np.cumsum(sizes)))]
        sizes, words = np.diff(cuts), words.filter(pa.array(full))
    return words, sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _groups(batches, COUNT_TOKENS):
        counted = pc.value_counts(word_column(part.column("text").combine_chunks())[0])
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([counted.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([counted.field("counts"), pa.array([part.num_rows], pa.int64())])], ["word", "c"]
        )
        del part, counted
    give_back()


def token_table(training: DataFrame) -> DataFrame:
    """(word, c, class): counts of every token of the training texts."""
    counts = training.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    last = F.conv(F.hex(F.substring("word", -2, 2)), 16, 10).cast("int")
    return counts.withColumn("class", last % TAIL_CLASSES)


@dataclass
class Vocabulary:
    """What a scorer needs of the counts; its size is bounded by KNOWN."""

    total: int
    distinct: int
    known: dict[bytes, int]  # the most frequent tokens: place in ``counts``
    counts: np.ndarray
    classes: np.ndarray  # of known tokens
    mass: np.ndarray  # log10 of each tail class's smoothed mass
    head: int  # tokens of the head, the first of the known ones

    @cached_property
    def words(self) -> pa.Array:
        """The known tokens by their places."""
        return pa.array(list(self.known), pa.binary())

    @property
    def base_log_total(self) -> float:
        return math.log10(self.total + 0.1 * (self.distinct + 1))


def vocabulary(tokens: DataFrame, known: int = KNOWN, head: int = HEAD) -> Vocabulary:
    """Totals, tail masses and the most frequent tokens, from the stored counts."""
    total, distinct = (int(x or 0) for x in tokens.agg(F.sum("c"), F.count("*")).first())
    # the least count such that at most ``known`` tokens have it: from a histogram in steps of a sixteenth of a power of two
    step = F.floor(F.log2("c") * 16).cast("int")
    histogram = sorted(((r[0], r[1]) for r in tokens.groupBy(step.alias("step")).count().collect()), reverse=True)
    taken, least = 0, None
    for s, n in histogram:
        if taken + n > known:
            break
        taken, least = taken + n, s
    rows = tokens.filter(step >= least).select("word", "c", "class").collect() if least is not None else []
    rows = sorted(((int(r["c"]), bytes(r["word"]), int(r["class"])) for r in rows), key=lambda r: (-r[0], r[1]))
    head = min(head, len(rows))
    smoothed = {int(r[0]): float(r[1] or 0) for r in tokens.groupBy("class").agg(F.sum(F.col("c") + 0.1)).collect()}
    mass = np.array([smoothed.get(k, 0.0) for k in range(TAIL_CLASSES)])
    for c, _, k in rows[:head]:
        mass[k] -= c + 0.1
    return Vocabulary(
        total, distinct, {w: i for i, (_, w, _) in enumerate(rows)}, np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.log10(np.maximum(mass, 0) + 0.1), head
    )


# ---- the network ------------------------------------------------------------------------------------------------


class Network:
    """A gated recurrent unit with an output of classes, and of tokens inside head classes."""

    def __init__(self, head: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = HEAD_CLASSES + TAIL_CLASSES
        self.size = max(1, -(-head // HEAD_CLASSES))
        scale = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {
            "E": scale(HEAD_CLASSES * self.size + TAIL_CLASSES, 3 * HIDDEN),
            "U": (rng.standard_normal((HIDDEN, 2 * HIDDEN)) / math.sqrt(HIDDEN)).astype(np.float32),
            "N": (rng.standard_normal((HIDDEN, HIDDEN)) / math.sqrt(HIDDEN)).astype(np.float32),
            "C": scale(HIDDEN, self.classes),
            "c": np.zeros(self.classes, np.float32),
            "W": scale(HEAD_CLASSES, HIDDEN, self.size),
            "w": np.zeros((HEAD_CLASSES, self.size), np.float32),
        }
        self.p["w"].ravel()[head:] = -30.0  # places of the last class that no token has
        self.start = HEAD_CLASSES * self.size + TAIL_CLASSES - 1  # never a gradient's problem: the first input
        self.moments: dict[str, np.ndarray] | None = None

    def unigram(self, vocabulary: Vocabulary) -> None:
        """Output biases from the counts, so that learning starts at the base model."""
        if not vocabulary.total:
            return
        counts = np.zeros(HEAD_CLASSES * self.size)
        counts[: vocabulary.head] = vocabulary.counts[: vocabulary.head] + 0.1
        each = counts.reshape(HEAD_CLASSES, self.size)
        mass = np.concatenate((each.sum(axis=1), 10.0**vocabulary.mass)) + 1e-3
        self.p["c"][:] = np.log(mass / mass.sum())
        self.p["w"][:] = np.where(each > 0, np.log(np.maximum(each, 1e-3) / np.maximum(each.sum(axis=1, keepdims=True), 1e-3)), -30.0)

    def forward(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> dict:
        """x: inputs (T, B); keep: 0 where a document starts. States of all steps and what the gradient needs."""
        (steps, streams), kind = x.shape, self.p["E"].dtype
        hs = np.empty((steps + 1, streams, HIDDEN), kind)
        hs[0] = h
        # the gates' arrays are whole for each gate and step, and their weights negative: the logistic function takes exp(-a)
        zr = np.empty((steps, 2, streams, HIDDEN), kind)
        for k in range(2):
            zr[:, k] = (-self.p["E"][:, k * HIDDEN : (k + 1) * HIDDEN]).take(x, axis=0)
        n = self.p["E"][:, 2 * HIDDEN :].copy().take(x, axis=0)
        u, un = -self.p["U"].reshape(HIDDEN, 2, HIDDEN).transpose(1, 0, 2), self.p["N"]
        before = np.empty_like(n)
        gates, inner = np.empty_like(zr[0]), np.empty_like(n[0])
        for t in range(steps):
            b, a, m, after = before[t], zr[t], n[t], hs[t + 1]
            np.multiply(hs[t], keep[t], out=b)
            a += np.matmul(b, u, out=gates)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            np.multiply(a[1], b, out=after)
            m += np.matmul(after, un, out=inner)
            np.tanh(m, out=m)
            np.subtract(b, m, out=after)
            after *= a[0]
            after += m
        return {"x": x, "keep": keep, "hs": hs, "zr": zr, "n": n, "before": before}

    def output(self, h: np.ndarray, cls: np.ndarray, place: np.ndarray, grad: bool = False):
        """Natural log probabilities of (class, place in the class) for states h (M, H); place -1: the class alone."""
        logp = np.empty(len(h), h.dtype)
        dh = np.empty_like(h) if grad else None
        grads = {k: np.zeros_like(self.p[k]) for k in "CcWw"} if grad else {}
        reach = float(max(h.max(initial=0), -h.min(initial=0)))

        def part(rows: slice, h: np.ndarray, own: np.ndarray, weights: np.ndarray, bias: np.ndarray, logp: np.ndarray, dh: np.ndarray | None, gw: np.ndarray | None, gb: np.ndarray | None) -> None:
            """One softmax over some rows: log probabilities, and the gradients divided by the sums where they are narrow."""
            h = h[rows]
            e = h @ weights
            e += bias
            if reach * np.abs(weights).sum(axis=0).max() + np.abs(bias).max() > 60:
                np.clip(e, -60, 60, out=e)
            np.exp(e, out=e)
            sums = e @ np.ones(e.shape[1], e.dtype)
            at = np.arange(len(h)) * e.shape[1] + own[rows]
            flat = e.reshape(-1)
            np.log(flat.take(at) / sums, out=logp[rows])
            if dh is not None:
                flat[at] -= sums
                inverse = 1 / sums
                gw += (h * inverse[:, None]).T @ e
                gb += inverse @ e
                np.multiply(e @ weights.T, inverse[:, None], out=dh[rows])

        for a in range(0, len(h), ROWS):
            part(slice(a, a + ROWS), h, cls, self.p["C"], self.p["c"], logp, dh, grads.get("C"), grads.get("c"))
        heads = np.flatnonzero(place >= 0)
        order = heads[np.argsort(cls[heads].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1)).tolist()
        inside, own, inside_logp = h.take(order, axis=0), place[order], np.empty(len(order), h.dtype)
        inside_dh = np.empty_like(inside) if grad else None
        for k in range(HEAD_CLASSES):
            for a in range(cuts[k], cuts[k + 1], 2 * ROWS):
                rows = slice(a, min(a + 2 * ROWS, cuts[k + 1]))
                part(rows, inside, own, self.p["W"][k], self.p["w"][k], inside_logp, inside_dh, grads["W"][k] if grad else None, grads["w"][k] if grad else None)
        logp[order] += inside_logp
        if grad:
            dh[order] += inside_dh
        return logp, dh, grads

    def backward(self, f: dict, dhs: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients through one window; dhs (T, B, H) from the outputs."""
        steps, streams = f["x"].shape
        da = np.empty((steps, 3, streams, HIDDEN), dhs.dtype)
        back = np.zeros((streams, HIDDEN), dhs.dtype)
        ut, nt = self.p["U"].reshape(HIDDEN, 2, HIDDEN).transpose(1, 2, 0).copy(), self.p["N"].T.copy()
        d, s, drb = np.empty_like(back), np.empty_like(back), np.empty_like(back)
        both = np.empty((2, streams, HIDDEN), dhs.dtype)
        for t in range(steps - 1, -1, -1):
            (z, r), n, b, (dz, dr, dn) = f["zr"][t], f["n"][t], f["before"][t], da[t]
            np.add(dhs[t], back, out=d)
            np.multiply(d, z, out=back)
            np.subtract(d, back, out=dn)  # d (1 - z)
            np.subtract(b, n, out=dz)
            dz *= dn
            dz *= z
            np.multiply(n, n, out=s)
            np.subtract(1, s, out=s)
            dn *= s
            np.matmul(dn, nt, out=drb)
            drb *= r
            back += drb
            np.multiply(drb, b, out=dr)
            np.subtract(1, r, out=s)
            dr *= s
            np.matmul(da[t, :2], ut, out=both)
            back += both[0]
            back += both[1]
            back *= f["keep"][t]
        x = f["x"].ravel()
        order = np.argsort(x.astype(np.min_scalar_type(len(self.p["E"]))), kind="stable")  # 16 bits go by radix
        ordered = x.take(order)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        b = f["before"].reshape(-1, HIDDEN)
        flat = [da[:, k].reshape(-1, HIDDEN) for k in range(3)]
        e = np.zeros_like(self.p["E"])
        e[ordered[starts]] = np.add.reduceat(np.concatenate(flat, axis=1).take(order, axis=0), starts, axis=0)
        rb = f["zr"][:, 1].reshape(-1, HIDDEN) * b
        return {"E": e, "U": np.concatenate((b.T @ flat[0], b.T @ flat[1]), axis=1), "N": rb.T @ flat[2]}

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        """AdaGrad."""
        if self.moments is None:
            self.moments = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        for k, g in grads.items():
            m = self.moments[k]
            m += g * g
            self.p[k] -= rate * g / np.sqrt(m)


# ---- documents in streams ---------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """All tokens of some documents, ends included."""

    place: np.ndarray  # among the known tokens, or -1
    tails: np.ndarray  # class by the last bytes
    sizes: np.ndarray  # tokens of each document
    rare: pa.ListArray  # of each document, the tokens that are not known


def encode(texts: pa.Array | list[str | None], v: Vocabulary) -> Tokens:
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    places, tails, sizes, rare, strange = [], [], [], [], []
    classes = v.classes if len(v.classes) else np.zeros(1, np.int64)
    for a, b in slices(text_sizes(texts), ENCODE_BYTES):
        words, own = word_column(texts.slice(a, b - a))
        ends = np.cumsum(own + 1) - 1
        inner = np.ones(len(words) + len(own), bool)
        inner[ends] = False
        place = np.full(len(inner), v.known.get(END, -1), np.int32)
        place[inner] = np.asarray(pc.fill_null(pc.index_in(words, value_set=v.words), -1))
        tail = classes[np.maximum(place, 0)].astype(np.int16)
        unknown = np.flatnonzero(place < 0)
        # ends come after the words here, as one more of them
        which = np.where(inner, np.cumsum(inner) - 1, len(words))[unknown]
        strange.append(pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(which)))
        tail[unknown] = tail_classes(strange[-1])
        rare.append(np.diff(np.searchsorted(unknown, ends, side="right"), prepend=0))
        places.append(place)
        tails.append(tail)
        sizes.append(own + 1)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(rare)))).astype(np.int32)
    return Tokens(np.concatenate(places), np.concatenate(tails), np.concatenate(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(strange)))


def layout(sizes: np.ndarray, streams: int) -> list[list[int]]:
    """Documents dealt to streams, longest first to the shortest stream; streams by descending length."""
    import heapq

    heap = [(0, s) for s in range(min(streams, max(1, len(sizes))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, s = heapq.heappop(heap)
        dealt[s].append(d)
        heapq.heappush(heap, (n + int(sizes[d]), s))
    length = {s: n for n, s in heap}
    return [dealt[s] for s in sorted(length, key=lambda s: -length[s])]


class Targets:
    """Class, place in the class and input of each token; -1 as place for tokens outside the head."""

    def __init__(self, net: Network, v: Vocabulary, t: Tokens):
        size = net.size
        head = (t.place >= 0) & (t.place < v.head)
        self.cls = np.where(head, t.place // size, HEAD_CLASSES + t.tails).astype(np.int16)
        self.place = np.where(head, t.place % size, -1).astype(np.int16)
        inputs = np.where(head, t.place, HEAD_CLASSES * size + t.tails).astype(np.int32)
        self.first = np.zeros(len(t.place), bool)
        self.first[np.cumsum(t.sizes) - t.sizes] = True
        self.before = np.concatenate((np.array([net.start], np.int32), inputs[:-1]))
        self.before[self.first] = net.start


def even_streams(n: int, streams: int) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive tokens cut into streams of one length, for training: (token places by step and stream, lengths)."""
    steps = max(1, -(-n // streams))
    at = np.arange(steps * (-(-n // steps)), dtype=np.int32).reshape(-1, steps).T
    lengths = np.minimum(steps, n - np.arange(at.shape[1]) * steps)
    return np.minimum(at, n - 1), lengths


def whole_streams(sizes: np.ndarray, streams: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole documents dealt to streams by descending length, for scoring."""
    starts, index = np.cumsum(sizes) - sizes, []
    for docs in layout(sizes, streams):
        index.append(np.concatenate([np.arange(starts[d], starts[d] + sizes[d], dtype=np.int32) for d in docs]))
    lengths = np.array([len(i) for i in index])
    at = np.zeros((int(lengths.max()), len(index)), np.int32)
    for k, i in enumerate(index):
        at[: len(i), k] = i
    return at, lengths


def windows(at: np.ndarray, lengths: np.ndarray, target: Targets, steps: int):
    """(token places (T, B), inputs, keep, mask); lengths descend, so the streams that still have tokens are the first."""
    for t in range(0, len(at), steps):
        b = int((lengths > t).sum())
        part = at[t : t + steps, :b]
        mask = np.arange(t, t + len(part))[:, None] < lengths[None, :b]
        yield part, target.before[part], (~target.first[part]).astype(np.float32)[:, :, None], mask


def train(net: Network, v: Vocabulary, texts: pa.Array | list[str | None], rate: float) -> int:
    """One pass of truncated backpropagation over the documents; the number of tokens."""
    tokens = encode(texts, v)
    target = Targets(net, v, tokens)
    at, lengths = even_streams(len(tokens.place), STREAMS)
    h = np.zeros((len(lengths), HIDDEN), np.float32)
    for part, x, keep, mask in windows(at, lengths, target, WINDOW):
        f = net.forward(x, keep, h[: x.shape[1]])
        live = slice(None) if mask.all() else np.flatnonzero(mask.ravel())
        own = part.ravel()[live]
        _, dh, grads = net.output(f["hs"][1:].reshape(-1, HIDDEN)[live], target.cls.take(own), target.place.take(own), grad=True)
        if len(own) < mask.size:
            dhs = np.zeros((mask.size, HIDDEN), np.float32)
            dhs[live] = dh
            dh = dhs
        grads |= net.backward(f, dh.reshape(*mask.shape, HIDDEN))
        scale = np.float32(1.0 / len(own))
        net.step({k: g * scale for k, g in grads.items()}, rate)
        h = f["hs"][-1]
    return len(tokens.place)


def score(net: Network, v: Vocabulary, texts: pa.Array | list[str | None]):
    """Per document: tokens, known tokens, base sum and model sum of log10 without what rare tokens add, rare tokens."""
    tokens = encode(texts, v)
    place, sizes = tokens.place, tokens.sizes
    target = Targets(net, v, tokens)
    at, lengths = whole_streams(sizes, STREAMS)
    logp = np.zeros(len(place))
    h = np.zeros((len(lengths), HIDDEN), np.float32)
    for part, x, keep, mask in windows(at, lengths, target, WINDOW):
        f = net.forward(x, keep, h[: x.shape[1]])
        live = slice(None) if mask.all() else np.flatnonzero(mask.ravel())
        own = part.ravel()[live]
        logp[own] = net.output(f["hs"][1:].reshape(-1, HIDDEN)[live], target.cls.take(own), target.place.take(own))[0]
        h = f["hs"][-1]
    del at, f, h
    logp /= math.log(10)
    known = place >= 0
    counted = np.append(np.log10(v.counts + 0.1), 0.0).take(place, mode="wrap")  # -1 is the last: 0 until the join
    tail = np.flatnonzero(target.place < 0)
    logp[tail] += counted[tail] - v.mass.take(tokens.tails[tail])
    starts = np.cumsum(sizes) - sizes
    base = np.add.reduceat(counted, starts) - sizes * v.base_log_total
    return sizes, np.add.reduceat(known.astype(np.int64), starts), base, np.add.reduceat(logp, starts), tokens.rare


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole rows of about ``most`` tokens (six bytes each), over the borders of batches."""
    held, total = [], 0
    for batch in batches:
        for a, b in slices(text_sizes(batch.column("text")), 6 * most):
            held.append(batch.slice(a, b - a))
            total += held[-1].column("text").nbytes
            if total >= 6 * most:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if total or any(h.num_rows for h in held):
        yield pa.Table.from_batches(held)


def _pack(net: Network, tokens: int) -> bytes:
    return pickle.dumps((tokens, net.p, net.moments), protocol=5)


# ---- distributed training and scoring ---------------------------------------------------------------------------

_SET = "slot int, tokens long, params binary"


def _averaged(sets: Iterator[tuple]) -> tuple | None:
    """Parameters averaged by tokens; scoring needs no moments."""
    total, mean = 0, None
    for n, p, *_ in sets:
        if not n:
            continue
        total += n
        if mean is None:
            mean = {k: v.astype(np.float64) for k, v in p.items()}
        else:
            for k in mean:
                mean[k] += (p[k] - mean[k]) * (n / total)
    return None if mean is None else (total, {k: v.astype(np.float32) for k, v in mean.items()})


def _trainer(start, vocabulary_var, rate: float, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = pickle.loads(vocabulary_var.value)
        net = Network(v.head)
        if start is None:
            net.unigram(v)
        else:
            _, net.p, net.moments = pickle.loads(start.value)
        tokens = 0
        if passes > 1:
            batches = list(batches)  # the warm start's bounded documents
        for k in range(passes):
            for part in _groups(iter(batches), TRAIN_TOKENS):
                tokens += train(net, v, part.column("text").combine_chunks(), rate * (1 - 0.7 * k / passes))
                del part
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([tokens], pa.int64()), pa.array([_pack(net, tokens)], pa.binary())], ["slot", "tokens", "params"])
        give_back()

    return run


def _merge(key, t):
    total, p = _averaged(pickle.loads(x.as_py()) for x in t.column("params")) or (0, None)
    return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "tokens": pa.array([total], pa.int64()), "params": pa.array([pickle.dumps((total, p), protocol=5)], pa.binary())})


def fit(training: DataFrame, v: Vocabulary, warm_docs: int = WARM_DOCS, rate: float = 0.05) -> bytes:
    """Trained parameters: a warm start in one task, then one pass of every partition, averaged by tokens."""
    sc = training.sparkSession.sparkContext
    shared = sc.broadcast(pickle.dumps(v, protocol=5))
    texts = training.select("text")
    # a share by a hash of the id, so nothing is sorted and only the sample is moved
    n_docs = int(v.counts[v.known[END]]) if END in v.known else 0
    share = min(1.0, warm_docs / max(1, n_docs))
    sample = training.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    first = sample.repartition(1).mapInArrow(_trainer(None, shared, rate, 4), _SET).collect()
    if not first:
        net = Network(v.head)
        net.unigram(v)
        return _pack(net, 0)
    start = sc.broadcast(bytes(first[0]["params"]))
    # most of 32 sets reach one task of the second step for each thousand partitions
    sets = texts.mapInArrow(_trainer(start, shared, rate, 1), _SET).groupBy("slot").applyInArrow(_merge, _SET)
    mean = _averaged(pickle.loads(bytes(r["params"])) for r in sets.filter("tokens > 0").toLocalIterator())
    return pickle.dumps(mean, protocol=5) if mean else bytes(first[0]["params"])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<binary>"


def _scorer(params, vocabulary_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pickle.loads(vocabulary_var.value)
        net = Network(v.head)
        net.p = pickle.loads(params.value)[1]
        for part in _groups(batches, SCORE_TOKENS):
            sizes, known, base, model, rare = score(net, v, part.column("text").combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks(), part.column("held_out").combine_chunks(), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model), rare],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare"],
            )
            del part, sizes, known, base, model, rare
        give_back()

    return run


def lm_scores(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", warm_docs: int = WARM_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)))
    training = rows.filter("doc_id IS NOT NULL AND NOT held_out")
    tokens = stored(token_table(training), "token-counts")
    v = vocabulary(tokens)
    params = spark.sparkContext.broadcast(fit(training, v, warm_docs))
    shared = spark.sparkContext.broadcast(pickle.dumps(v, protocol=5))
    # the written rows fix each row's number, by which rare tokens find their way back
    scored = stored(rows.select("doc_id", "held_out", "text").mapInArrow(_scorer(params, shared), _SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    counted = rare.join(tokens.select("word", "c"), "word", "left")
    unseen = math.log10(0.1)
    added = counted.groupBy("row").agg(F.sum(F.coalesce(F.log10(F.col("c") + 0.1), F.lit(unseen))).alias("log"), F.count("c").alias("seen"))
    out = scored.drop("rare").join(added, "row", "left")
    log, seen = F.coalesce("log", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("model") + log).alias("score")
    )
