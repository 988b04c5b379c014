"""Whole-text byte-level BPE with the tokenizers library, faster by remembering what it gave for each word.

The pre-tokenizer of a byte-level BPE ends a token before every space that starts a run of white space, and
before the last space of such a run if a visible character follows. So a text may be cut at these spaces, each
piece encoded alone, and the ids joined; ``encode`` cuts only there and gives texts with other runs of white
space, or with white space of which libraries differ, to the library whole. A piece is cut again at single line ends, which
are tokens, and a trailing run of punctuation after a letter is a token of its own too. A run of letters, with or
without a space before it, is one word to the pre-tokenizer, so such words go to the library's model at once.

Pieces and words are Arrow columns and their ids lists of a column: Python holds no object for either, but for a word while it is learnt.
"""

from __future__ import annotations

import codecs
import ctypes
import gc
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a Python worker remembers (about 20 MB); beyond, those that the last slice of texts used.
MAX_PIECES = 300_000
#: Bytes of text encoded together.
TEXT_ROOM = 3_000_000
#: New pieces given to the library at a time: it holds over 100 bytes a token until it has returned.
LEARN_ROOM = 10_000
#: Words whose tokens are Python objects at a time: few enough that these are made again in the same places.
WORD_ROOM = 200
#: White space but for the space and the line end, as any library may know it.
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Bytes by which it, or "<", may be in a text: itself in ASCII, else the first byte of some of it.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[ord("<"), *(chr(c).encode()[0] for c in range(0x3100) if _OTHER_SPACE.match(chr(c)))]] = True
_TAIL = ".,;:!?&%$*#|"
#: Longest trailing run of punctuation that is told apart from its word.
_TAIL_BYTES = 8
#: Byte-level models spell each byte as one visible character: itself where Latin-1 shows it, else the next from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_HIDDEN = sorted(set(range(256)) - set(_SHOWN))
_SPELLING = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))
_SHARED: dict[str, "PieceEncoder"] = {}


def digest_of(tokenizer_json: str) -> str:
    """SHA-256 of the tokenizer's file: its version."""
    return hashlib.sha256(tokenizer_json.encode()).hexdigest()


def shared_encoder(tokenizer_json: str) -> "PieceEncoder":
    """One encoder for each Python worker, kept over tasks."""
    if (key := digest_of(tokenizer_json)) not in _SHARED:
        _SHARED[key] = PieceEncoder(tokenizer_json)
    return _SHARED[key]


def give_back() -> None:
    """Returns free memory of Arrow's and the C library's, where they can. Done when a task ends, since Spark keeps workers that wait beside those that run."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def _lists(lengths: np.ndarray, values: np.ndarray | pa.Array) -> pa.LargeListArray:
    """Lists of ids of these lengths out of all their values."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)), pa.array(values, pa.int32()))


def _lengths(lists: pa.LargeListArray) -> np.ndarray:
    return np.asarray(pc.list_value_length(lists))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and the bytes of a column of strings without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int32)
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


class PieceEncoder:
    def __init__(self, tokenizer_json: str, max_pieces: int = MAX_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.max_pieces = max_pieces
        self.model = self.tokenizer.model
        self.letters: set[str] = set()
        self.others: set[str] = set()
        self._empty()
        described = json.loads(tokenizer_json)
        pre = described.get("pre_tokenizer") or {}
        line_end = self._library(["\n"])[0]
        self.line_end = int.from_bytes(line_end[:4], "little")
        # texts are cut at spaces and searched for "<" alone, so every added token must have the one and not the other
        added = [t["content"] for t in described.get("added_tokens") or []]
        self.splits = all("<" in t and " " not in t for t in added) and len(line_end) == 4 and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not described.get("normalizer")

    def _empty(self) -> None:
        """What is known: words, each after a space, a line end, or a tab if a whole piece stands for itself; and their ids."""
        self.known, self.ids = pa.array([], pa.string()), _lists(np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.tails: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Gives the memory of what was learnt back."""
        self._empty()
        give_back()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_letter(self, c: str) -> bool:
        """Whether the pre-tokenizer keeps the character in a run of letters."""
        if c not in self.letters and c not in self.others:
            (self.letters if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a")) == 1 else self.others).add(c)
        return c in self.letters

    def _words(self, stems: pa.Array, before: str) -> pa.LargeListArray:
        """The ids of each stem after ``before``: of a run of letters, which the pre-tokenizer would keep in one piece, from the model."""
        listed = stems.to_pylist()
        codes = np.frombuffer("".join(listed).encode("utf-32-le"), "<u4")
        other = np.zeros(0x110000, bool)
        other[codes] = True
        for c in np.flatnonzero(other).tolist():
            other[c] = not self._is_letter(chr(c))
        sizes = np.asarray(pc.utf8_length(stems)).astype(np.int64)
        sure = ~np.logical_or.reduceat(other[codes], np.cumsum(sizes) - sizes)
        del codes
        if not sure.all():
            order = np.argsort(np.concatenate((np.flatnonzero(sure), np.flatnonzero(~sure))))
            both = [self._words(stems.filter(pa.array(sure)), before)] if sure.any() else []
            made = self._each(stems.filter(pa.array(~sure)).to_pylist(), before)
            both.append(_lists(np.array([len(x) // 4 for x in made]), np.frombuffer(b"".join(made), "<i4")))
            return pa.concat_arrays(both).take(pa.array(order))
        spelt = codecs.charmap_decode(("\n" + before).join(["", *listed]).encode(), "strict", _SPELLING)[0].split(_SPELLING[10])
        tokenize, lengths, ids = self.model.tokenize, [], []
        for at in range(1, len(spelt), WORD_ROOM):
            made = [tokenize(w) for w in spelt[at : at + WORD_ROOM]]
            lengths += map(len, made)
            ids.append(np.array([t.id for tokens in made for t in tokens], np.int32))
        return _lists(np.array(lengths), np.concatenate(ids))

    def _each(self, stems: list[str], before: str) -> list[bytes]:
        """The ids of each stem after ``before``, from one text of a stem a line: a line end is a token of its own there."""
        if len(stems) > LEARN_ROOM:
            return [v for i in range(0, len(stems), LEARN_ROOM) for v in self._each(stems[i : i + LEARN_ROOM], before)]
        if not stems:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(["\n" + before + s for s in stems])], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(stems):
            return self._library([before + s for s in stems])
        raw = ids.tobytes()
        at = (4 * ends).tolist() + [len(raw)]
        return [raw[a + 4 : b] for a, b in zip(at, at[1:])]

    def _learn(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of new words, each with what it stands after."""
        (offsets, data), plain = _bytes_of(words), pc.utf8_slice_codeunits(words, 1)
        first, order, made = data[offsets[:-1]], [], []
        for before in " \n\t":
            if not len(at := np.flatnonzero(first == ord(before))):
                continue
            stems = plain.take(pa.array(at))
            if before == " ":
                made.append(self._words(stems, " "))
            elif before == "\n":
                alone = self._words(stems, "")
                lengths = _lengths(alone)
                values = np.insert(np.asarray(alone.flatten()), np.cumsum(lengths) - lengths, self.line_end)
                made.append(_lists(lengths + 1, values.astype(np.uint32).view(np.int32)))
            else:
                made.append(self._whole([" " + p for p in stems.to_pylist()]))
            order.append(at)
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(order))))

    def _look_up(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words in what is known; what is new is learnt."""
        found = pc.index_in(words, value_set=self.known)
        missing = words.filter(pc.is_null(found))
        place = np.asarray(pc.fill_null(found, -1)).astype(np.int64)
        new = place < 0
        if len(self.known) + len(missing) > self.max_pieces:
            kept = pa.array(place[~new])
            self.known, self.ids = self.known.take(kept), self.ids.take(kept)
            place[~new] = np.arange(len(kept))
        place[new] = len(self.known) + np.arange(len(missing))
        if len(missing):
            # the many small objects made here are no garbage; looking for cycles among them takes most of the time
            collects = gc.isenabled()
            gc.disable()
            try:
                learnt = self._learn(missing)
            finally:
                if collects:
                    gc.enable()
            self.known, self.ids = pa.concat_arrays([self.known, missing]), pa.concat_arrays([self.ids, learnt])
        return place

    def _of_pieces(self, pieces: pa.Array) -> pa.LargeListArray:
        """The ids of distinct pieces that follow a space, from those of their words and of the punctuation after these."""
        n = len(pieces)
        lines = pc.split_pattern(pieces, "\n")
        sizes, lines = np.asarray(pc.list_value_length(lines)).astype(np.int64), lines.flatten()
        owner = np.repeat(np.arange(n), sizes)
        # a piece with other white space, a line without a word, or what may be an added token is left whole
        whole = np.zeros(n, bool)
        offsets, data = _bytes_of(pieces)
        at = np.flatnonzero(_MAYBE_SPACE[data[offsets[0] : offsets[-1]]]) + offsets[0]
        maybe = np.unique(np.searchsorted(offsets, at, side="right") - 1)
        whole[maybe] = ["<" in p or _OTHER_SPACE.search(p) is not None for p in pieces.take(pa.array(maybe)).to_pylist()]
        whole[owner[np.asarray(pc.binary_length(lines)) == 0]] = True
        if whole.any():
            lines, owner = lines.filter(pa.array(~whole[owner])), owner[~whole[owner]]
        # trailing punctuation of a few bytes after a letter, told by its bytes in one number
        trimmed = pc.utf8_rtrim(lines, characters=_TAIL)
        cut = np.asarray(pc.binary_length(lines)).astype(np.int64) - np.asarray(pc.binary_length(trimmed))
        tailed = np.flatnonzero((cut > 0) & (cut <= _TAIL_BYTES))
        last = pc.utf8_slice_codeunits(trimmed.take(pa.array(tailed)), -1).dictionary_encode()
        tailed = tailed[np.array([c != "" and self._is_letter(c) for c in last.dictionary.to_pylist()], bool)[np.asarray(last.indices)]]
        has = np.zeros(len(lines), bool)
        has[tailed] = True
        offsets, data = _bytes_of(lines)
        code, ends, cut = np.zeros(len(tailed), np.uint64), offsets[1:][tailed], cut[tailed]
        for k in range(int(cut.max(initial=0))):
            more = np.flatnonzero(cut > k)
            code[more] = code[more] << np.uint64(8) | data[ends[more] - cut[more] + k].astype(np.uint64)
        codes, tail = np.unique(code, return_inverse=True)
        tails = [int(c).to_bytes(_TAIL_BYTES, "big").lstrip(b"\0") for c in codes]
        if fresh := [t for t in tails if t not in self.tails]:
            self.tails.update(zip(fresh, self._library([t.decode() for t in fresh])))
        # words in the order of their pieces, then the pieces that are left whole
        begins = np.concatenate(([True], owner[1:] != owner[:-1]))[: len(owner)]
        before = pa.array([" ", "\n"]).take(pa.array(np.where(begins, 0, 1)))
        words = pc.binary_join_element_wise(before, pc.if_else(pa.array(has), trimmed, lines), "")
        left = pieces.filter(pa.array(whole))
        words = pa.concat_arrays([words, pc.binary_join_element_wise(pa.scalar("\t"), left, "")]) if len(left) else words
        coded = words.dictionary_encode()
        place = self._look_up(coded.dictionary)[np.asarray(coded.indices)]
        has, begins = (np.concatenate((x, np.full(len(left), y))) for x, y in ((has, False), (begins, True)))
        starts = np.cumsum(1 + has) - (1 + has)
        parts = np.empty(len(has) + len(tailed), np.int64)
        parts[starts] = place
        parts[starts[has] + 1] = len(self.ids) + tail
        raw = [self.tails[t] for t in tails]
        lists = pa.concat_arrays([self.ids, _lists(np.array([len(x) // 4 for x in raw], np.int64), np.frombuffer(b"".join(raw), "<i4"))]).take(pa.array(parts))
        made = _lists(np.add.reduceat(_lengths(lists), starts[begins]), lists.flatten()) if n else lists
        if not len(left):
            return made
        return made.take(pa.array(np.argsort(np.concatenate((np.flatnonzero(~whole), np.flatnonzero(whole))))))

    def _whole(self, texts: list[str]) -> pa.LargeListArray:
        raw = self._library(texts)
        return _lists(np.array([len(x) // 4 for x in raw], np.int64), np.frombuffer(b"".join(raw), "<i4"))

    def _entries(self, texts: pa.Array) -> tuple[pa.LargeListArray, np.ndarray, np.ndarray]:
        """Distinct id lists, which of them make up the texts in order, and how many of them each text has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.splits:
            return self._whole(texts.to_pylist()), np.arange(len(texts)), np.ones(len(texts), np.int64)
        pieces = pc.split_pattern(texts, " ")
        coded = pieces.flatten().dictionary_encode()
        at = np.asarray(coded.indices)
        sizes = np.asarray(pc.list_value_length(pieces)).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        del pieces
        # a space with white space before it and after it (or the end) is inside a run: such texts are left whole
        blank = np.asarray(pc.equal(pc.binary_length(coded.dictionary), 0))
        starts_so, ends_so = (blank | np.asarray(pc.utf8_is_space(pc.utf8_slice_codeunits(coded.dictionary, a, b))) for a, b in ((0, 1), (-1, None)))
        inner = np.zeros(len(at), bool)
        inner[1:] = ends_so[at[:-1]] & starts_so[at[1:]]
        inner[starts] = (sizes > 1) & blank[at[starts]]
        whole = np.add.reduceat(inner, starts) > 0 if len(starts) else np.zeros(0, bool)
        rest = np.repeat(~whole, sizes)
        rest[starts] = False
        seen = np.zeros(len(blank), bool)
        seen[at[rest]] = True
        used = np.flatnonzero(seen)
        place = np.cumsum(seen, dtype=np.int32) - 1
        # the first piece of a text follows no space; of a whole text it stands for all of it
        heads = pc.if_else(pa.array(whole), texts, coded.dictionary.take(pa.array(at[starts]))).to_pylist()
        entries = pa.concat_arrays([self._of_pieces(coded.dictionary.take(pa.array(used))), self._whole(heads)])
        entry = place[at]
        entry[starts] = len(used) + np.arange(len(starts), dtype=np.int32)
        keep = rest.copy()
        keep[starts] = True
        return entries, entry[keep], np.where(whole, 1, sizes)

    def count_column(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        entries, entry, sizes = self._entries(texts)
        if not len(sizes):
            return np.zeros(0, np.int64)
        return np.add.reduceat(_lengths(entries)[entry], np.cumsum(sizes) - sizes)

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, pa.Array]:
        """The number of ids of each text, with ``end_id`` after each if given; and all ids in a row."""
        entries, entry, sizes = self._entries(texts)
        if not len(sizes):
            return np.zeros(0, np.int64), pa.array([], pa.int32())
        if end_id is not None:
            entry = np.insert(entry, np.cumsum(sizes), len(entries))
            entries, sizes = pa.concat_arrays([entries, _lists(np.ones(1, np.int64), np.array([end_id], np.uint32).view(np.int32))]), sizes + 1
        return np.add.reduceat(_lengths(entries)[entry], np.cumsum(sizes) - sizes), entries.take(pa.array(entry)).flatten()

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit integers. What is new is learnt once for all of them."""
        sizes, values = self.encode_column(pa.array(texts, pa.string()))
        raw = np.asarray(values).astype("<u4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


def slices(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Runs of consecutive rows of about ``room`` in size, one row at least."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= room:
            out.append((start, i + 1))
            start, total = i + 1, 0
    return [*out, (start, len(sizes))] if start < len(sizes) else out


def text_sizes(column) -> list[int]:
    """Bytes of each text of an Arrow column."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def load(path: str) -> str:
    """The tokenizer file's text, read once on the driver; executors get it with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
