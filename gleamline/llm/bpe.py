"""Byte pair encoding and decoding with a pair occurrence index.

The words of a partition's batch that are new to the task are laid out in one array of symbols.  An index
maps the rank of each mergeable pair to all positions where it stands; ranks are applied in
ascending order, each to all its positions at once, and the positions whose neighbours changed are
entered again under their new ranks.  A word's tokens are kept for the task's later documents, in a
table of bounded size; what that table holds never changes a result.  Words of ASCII and the letters up
to U+00FF are found in the bytes of a whole batch at once, so that a word is one entry, whatever signs
are next to it; others by the word pattern.

The vocabulary file is that of the tokenizers library: NFC, white space and case folding, splitting
into words, special tokens, bytes as symbols, merges and word ends are as the file says.  ``encode``
returns the ids that library returns without added special tokens, ``decode`` what its ``decode``
returns with special tokens kept.

Defined cases: a null or empty text has no tokens and decodes to the empty text.  Texts of any length
are taken whole.  Rows that repeat and null identifiers are passed on as they are; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleamline.llm.common import bounded, column, slices

# The characters the vocabulary's splitting takes for white space, and its word pattern.
SPACES = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^%s\p{L}\p{N}]+"

_WORD = regex.compile(WORD % "".join(map(chr, SPACES)))


# What a byte is to the word pattern; a word with bytes beyond these is split by the pattern itself.
_OTHER, _LETTER, _DIGIT, _SPACE = range(4)
_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0x80:0xC0] = _KIND[0xC3] = _LETTER  # the letters from U+00C0 to U+00FF, and two signs
_KIND[9:14] = _KIND[32] = _SPACE
_ODD = np.zeros(256, bool)
_ODD[39] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """The merges and tokens of a vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], dict(spec["model"]["vocab"])
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for text, i in [*ids.items(), *self.special.items()]:
            self.token[i] = text
        of_byte = byte_symbols()
        self.inner = np.array([ids[of_byte[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[of_byte[b] + self.end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.left = keys // self.size
        self.twin = self.left == keys % self.size
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.none = len(pairs)
        born = np.full(self.size, -1)
        born[self.made] = np.arange(self.none)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        if len(np.unique(self.made)) < self.none or (np.maximum(born[self.left], born[right]) >= born[self.made]).any():
            raise ValueError("a merge must stand below those that make its parts, and each make a token of its own")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.cut = regex.compile("|".join(regex.escape(t) for t in self.special) or r"(?!)")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` where it doesn't merge; symbol -1 is a word's border."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), self.none - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.order[at], self.none)

    def words(self, chunk: str) -> list[str | int]:
        """A chunk without white space: its words, normalised, or the ids of special tokens."""
        if chunk.isascii() or max(chunk) <= "\xff":  # such texts are in normal form
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return [chunk[:-1].lower(), chunk[-1]]
            if "<|" not in chunk:
                return _WORD.findall(chunk.lower())
        out: list[str | int] = []
        at = 0
        for m in [*self.cut.finditer(chunk), None]:
            part = chunk[at : m.start() if m else len(chunk)]
            if part:
                out += _WORD.findall(self.library.normalizer.normalize_str(part))
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in one array, and where each word's tokens begin and end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # Each word is followed by a border symbol; there is one in front of the first, too.
        begin = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        n = int(sizes.sum()) + len(words) + 1
        sym = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[0] = False
        inside[begin + sizes] = False
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym[inside] = self.inner[raw]
        ends = begin + sizes - 1
        sym[ends] = self.last[raw[np.cumsum(sizes) - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, self.none, np.int64)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        alive = inside.copy()

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, of: np.ndarray) -> None:
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            edges = np.flatnonzero(np.diff(of, prepend=-1))
            for lo, hi, r in zip(edges.tolist(), [*edges[1:].tolist(), len(of)], of[edges].tolist()):
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(active, r)

        found = np.flatnonzero(rank < self.none)
        enter(found, rank[found])
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.twin[r]:
                at = _apart(at, after)
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.made[r]
            alive[gone] = False
            rank[gone] = self.none
            after[at] = beyond
            before[beyond] = at
            changed = np.concatenate([at, before[at]])
            changed = changed[alive[changed]]
            new = self.ranks(sym[changed], sym[after[changed]])
            rank[changed] = new
            can = new < self.none
            if can.any():
                enter(changed[can], new[can])
            # New pairs hold a token just made, so they rank below: ascending order is each word's own.
        kept = np.cumsum(alive) - alive
        return sym[alive], np.stack([kept[begin], kept[begin + sizes]])


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of positions that overlap, as in aaa, every second one from the left."""
    out, last = [], -1
    for p in np.sort(at).tolist():
        if p != last:
            out.append(p)
            last = int(after[p])
    return np.array(out, np.int64)


def split(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts, which begin and end ``at``, without white space; where their words begin; ``at`` among these bytes.

    Words are in lower case and what the word pattern finds.  A chunk between white space that needs more than
    ASCII and the letters up to U+00FF, or has an apostrophe or ``<|``, is left whole.
    """
    space = _KIND[raw] == _SPACE
    opens = np.append(True, space)
    opens[at] = True
    begins = opens[:-1][~space]
    at = at - np.searchsorted(np.flatnonzero(space), at)
    raw = raw[~space]
    plain, kind = _LOWER[raw], _KIND[raw]
    words = np.ones(len(raw), bool)
    words[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    accent = np.flatnonzero(raw[:-1] == 0xC3)
    after = raw[accent + 1]
    upper = accent[(after >= 0x80) & (after < 0x9F) & (after != 0x97)] + 1
    plain[upper] += 32
    signs = accent[(after == 0x97) | (after == 0xB7)]
    bars = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
    bars = bars[~begins[bars + 1]]
    odd = np.concatenate([np.flatnonzero(_ODD[raw]), signs, bars])
    if len(odd):
        chunks = np.append(np.flatnonzero(begins), len(raw))
        whole = np.zeros(len(raw) + 1, np.int8)
        mine = np.unique(np.searchsorted(chunks, odd, "right"))
        whole[chunks[mine - 1]] = 1
        whole[chunks[mine]] -= 1
        whole = np.cumsum(whole[:-1], dtype=np.int8).view(bool)
        words &= ~whole
        # Folding case there would make special tokens, and comes after composing.
        plain[upper[whole[upper]]] -= 32
        special = np.unique(np.searchsorted(chunks, bars, "right"))
        for lo, hi in zip(chunks[special - 1].tolist(), chunks[special].tolist()):
            plain[lo:hi] = raw[lo:hi]
    return plain, np.flatnonzero(words | begins), at


class Encoder:
    """Encodes documents; keeps the tokens of words and chunks, twice ``keep`` and one batch's at most.

    ``form`` makes of the ids of many words, given in one array with each word's begin and end, what is
    kept of each word; a document is these joined.  A chunk that ``split`` leaves whole is kept like a word:
    it holds what no word of ``split`` does, or is the word itself.
    """

    def __init__(self, vocabulary: Vocabulary, form: Callable, keep: int):
        self.vocabulary, self.form, self.keep = vocabulary, form, keep
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """All documents joined, and where each begins and the last ends."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        plain, begins, at = split(np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0])
        cuts = np.append(begins, len(plain))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(plain)]).dictionary_encode()
        values = pa.array(self._values(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        _, offsets, data = values.buffers()
        ends = np.frombuffer(offsets, np.int64) if len(values) else np.zeros(1, np.int64)
        return memoryview(data or b""), ends[np.searchsorted(cuts, at)].tolist()

    def _values(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        values = list(map(self.known.get, words))
        new = []
        for i in [i for i, value in enumerate(values) if value is None]:
            word = words[i]
            value = self.older.get(word)
            if value is None:
                new.append(i)
            else:
                values[i] = self.known[word] = value
        if new:
            self._learn([words[i] for i in new])
            for i in new:
                values[i] = self.known[words[i]]
        return values

    def _learn(self, new: list[bytes]) -> None:
        known, form = self.known, self.form
        fresh, parts = [], {}
        for c in new:
            if c.isalpha():
                fresh.append(c)
            else:
                p = [w if isinstance(w, int) else w.encode() for w in self.vocabulary.words(c.decode())]
                if p == [c]:
                    fresh.append(c)
                else:
                    parts[c] = p
        more = {w for p in parts.values() for w in p}.difference(fresh)
        special = [w for w in more if isinstance(w, int)]
        fresh += [w for w in more if not isinstance(w, int) and w not in known]
        if fresh:
            ids, (lo, hi) = self.vocabulary.merge(fresh)
            known.update(zip(fresh, form(ids, lo.tolist(), hi.tolist())))
        alone = dict(zip(special, form(np.array(special), range(len(special)), range(1, len(special) + 1))))
        for c, p in parts.items():
            known[c] = b"".join([alone[w] if isinstance(w, int) else known[w] for w in p])


def packed(ids: np.ndarray, lo: Iterable[int], hi: Iterable[int]) -> list[bytes]:
    """Each word's ids as little-endian unsigned 32-bit numbers."""
    raw = ids.astype("<u4").tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(lo, hi)]


def written(token: list[str]) -> Callable:
    """Each word's ids in decimal and its tokens, two by two, a blank, which no token holds, after each."""
    both = [f"{i} {t} ".encode() for i, t in enumerate(token)]

    def form(ids: np.ndarray, lo: Iterable[int], hi: Iterable[int]) -> list[bytes]:
        each = [both[i] for i in ids.tolist()]
        return [b"".join(each[a:b]) for a, b in zip(lo, hi)]

    return form


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """A worker's encoder, kept between its tasks: ``ids`` gives packed ids, ``text`` decimals and tokens."""
    if (path, kind) not in _encoders:
        vocabulary = Vocabulary(path)
        ids = kind == "ids"
        form = packed if ids else written(vocabulary.token)
        _encoders[path, kind] = Encoder(vocabulary, form, 200_000 if ids else 120_000)
    return _encoders[path, kind]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): every text's token ids.  ``path`` is that of the vocabulary file on every executor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "ids")
        for part in bounded(batches, 1):
            joined, ends = enc.encode(part.column(1))
            values = pa.array(np.frombuffer(joined, "<i4", ends[-1] // 4))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends) // 4, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the tokens of ``ids`` as the vocabulary writes them, blanks between them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder(path, "ids").vocabulary.token
        for part in slices(batches):
            texts = [" ".join([token[i] for i in ids or ()]) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = coded.select(column(id_col).alias("id"), column(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded in one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "text")
        for part in bounded(batches, 1):
            counts, ids, decoded = [], [], []
            joined, ends = enc.encode(part.column(1))
            for a, b in zip(ends, ends[1:]):
                flat = bytes(joined[a : b - 1]).split(b" ") if b > a else []
                counts.append(len(flat) // 2)
                ids.append(hashlib.sha256(b" ".join(flat[::2])).hexdigest())
                decoded.append(hashlib.sha256(b" ".join(flat[1::2])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
