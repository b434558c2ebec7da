"""Cross-tokenizer alignment counts from inverted pair bitmaps.

A text is cut by two vocabularies; where tokens of both end at the same byte, they are linked.  Documents
are read in blocks.  A block keeps, per pair of linked ids, one compressed bitmap of its documents
for each binary digit of how often the pair is linked there (a multiplicity plane): a short list of
places, or a bit per document where that is smaller.  The planes of a pair OR-merged are the documents that hold
it, so a popcount gives its documents, and popcounts weighted by the planes' place values its links.  The
same planes, read as postings, carry each pair's corpus-wide counts back to the documents.

A block is bounded in documents and bytes of text, and so are the pairs it holds.  Bitmaps never leave
their block: only (block, pair, counts) rows are shuffled by pair, at most one per block for even the commonest pair.

Defined cases: a null or empty text, and one whose tokens' bytes are not a blank and the text, has
no tokens and zeros.  Repeated rows are documents of their own and all count.  Ties for the best
partner all count.  A long text is one document of one block and is encoded whole.  An empty table gives no rows.
Identifiers keep their type, null included; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleamline.llm.common import bounded, column
from gleamline.session import stage

BLOCK_DOCS = 4096
BLOCK_BYTES = 4 << 20
IDS = 1 << 16
# The fixed rule that cuts a text for the first vocabulary.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_RUN = re.compile(r"\S{2048}|\s{2048}")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the first vocabulary's file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteTokens:
    """Encoder of a byte-level vocabulary file, without special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        self.path, self._slow = path, None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if made != sorted(set(made)):
            raise ValueError(f"merges of {path} do not stand in the order of their ids")
        # Other entries are special tokens, whose strings in a text are plain text.
        whole = {*made, *(model["vocab"][ch] for ch in letters)}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if i in whole}
        self.bytes_of = [b""] * (max(whole) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self._fast = tiktoken.Encoding("bytes", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if not _LONG_RUN.search(text):
            return self._fast.encode_ordinary(text)
        # The merge of one piece takes quadratic time there, and not here; the ids are the same.
        if self._slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Encoder of a piece vocabulary with byte fallback, which sets a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode()
            for i in range(self._model.get_piece_size())
            for p in [self._model.id_to_piece(i)]
        ]

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text)


@cache
def _encoders(first: str, second: str) -> tuple:
    a, b = ByteTokens(first), PieceTokens(second)
    if max(len(a.bytes_of), len(b.bytes_of)) > IDS:
        raise ValueError(f"a pair of ids is kept in two halves of 16 bits; a vocabulary has more than {IDS} ids")
    tables = []
    for t in (a, b):
        sizes = np.array([len(x) for x in t.bytes_of], np.int64)
        tables.append((sizes, *(np.array([b"%d%s" % (i, end) for i in range(len(sizes))], object) for end in (b",", b"|", b";"))))
    return a, b, *tables


class Block:
    """What a block gathers: a row per document, and the places of linked pairs."""

    def __init__(self):
        self.rows = {"doc": [], "n_a": [], "n_b": [], "n_groups": [], "groups_sha256": []}
        self.size, self.keys, self.times = 0, [], []

    def add(self, docs: list, texts: list[str | None], first: str, second: str) -> None:
        a, b, (a_sizes, a_in, a_end, _), (b_sizes, b_in, _, b_end) = _encoders(first, second)
        ids = ([], [])
        ends = np.zeros((2, len(texts) + 1), np.int64)
        for i, text in enumerate(texts):
            x, y = [], []
            if text:
                x, y, whole = a.encode(" " + text), b.encode(text), (" " + text).encode()
                if b"".join(map(a.bytes_of.__getitem__, x)) != whole or b"".join(map(b.bytes_of.__getitem__, y)) != whole:
                    x, y = [], []
            ids[0].append(np.array(x, np.int64))
            ids[1].append(np.array(y, np.int64))
            ends[:, i + 1] = ends[0, i] + len(x), ends[1, i] + len(y)
        x, y = (np.concatenate(t) if t else np.zeros(0, np.int64) for t in ids)
        # Texts stand one after the other: a text's last byte ends a token of both.
        at_x, at_y = np.cumsum(a_sizes[x]), np.cumsum(b_sizes[y])
        last_x = np.flatnonzero(np.isin(at_x, at_y, assume_unique=True))
        last_y = np.flatnonzero(np.isin(at_y, at_x, assume_unique=True))
        groups = np.searchsorted(last_x, ends[0])
        self._note(docs, x, y, last_x, last_y, ends, groups, (a_in, a_end, b_in, b_end))
        doc = np.repeat(np.arange(len(texts)), np.diff(groups)) + self.size
        key, times = np.unique(((x[last_x] << 16 | y[last_y]) << 16) | doc, return_counts=True)
        self.keys.append(key)
        self.times.append(times)
        self.size += len(texts)

    def _note(self, docs, x, y, last_x, last_y, ends, groups, written) -> None:
        a_in, a_end, b_in, b_end = written
        # A group is written as its first side's ids and then its second side's.
        group_x, group_y = np.searchsorted(last_x, np.arange(len(x))), np.searchsorted(last_y, np.arange(len(y)))
        parts = np.empty(len(x) + len(y), object)
        ids_x, ids_y = a_in[x], b_in[y]
        ids_x[last_x], ids_y[last_y] = a_end[x[last_x]], b_end[y[last_y]]
        parts[np.arange(len(x)) + np.concatenate([[0], last_y + 1])[group_x]] = ids_x
        parts[np.arange(len(y)) + (last_x + 1)[group_y]] = ids_y
        at = ends.sum(axis=0)
        for i, doc in enumerate(docs):
            line = b"".join(parts[at[i] : at[i + 1]].tolist())[:-1]
            self.rows["doc"].append(doc)
            self.rows["n_a"].append(int(ends[0, i + 1] - ends[0, i]))
            self.rows["n_b"].append(int(ends[1, i + 1] - ends[1, i]))
            self.rows["n_groups"].append(int(groups[i + 1] - groups[i]))
            self.rows["groups_sha256"].append(hashlib.sha256(line).hexdigest() if line else "")

    def planes(self) -> "Planes":
        key = np.concatenate([np.zeros(0, np.int64), *self.keys])
        times = np.concatenate([np.zeros(0, np.int64), *self.times])
        return Planes.of(key >> 16, key & 0xFFFF, times, self.size)


class Planes:
    """Bitmaps of documents by (pair, binary digit): ``pair``, ``digit``, ``members`` and two payloads."""

    def __init__(self, pair, digit, members, places, bits, docs):
        self.pair, self.digit, self.members, self.places, self.bits, self.docs = pair, digit, members, places, bits, docs

    @classmethod
    def of(cls, pair: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> "Planes":
        parts = []
        for k in range(int(times.max()).bit_length() if len(times) else 0):
            on = np.flatnonzero(times >> k & 1)
            parts.append(((pair[on] << 6 | k), doc[on]))
        plane = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in parts)])
        doc = np.concatenate([np.zeros(0, np.int64), *(d for _, d in parts)])
        order = np.lexsort((doc, plane))
        plane, doc = plane[order], doc[order]
        names, members = np.unique(plane, return_counts=True)
        dense = cls._dense(members, docs)
        in_dense = np.repeat(dense, members)
        grid = np.zeros((int(dense.sum()), docs), bool)
        grid[np.repeat(np.arange(len(grid)), members[dense]), doc[in_dense]] = True
        return cls(names >> 6, names & 63, members, doc[~in_dense].astype(np.uint16), np.packbits(grid, axis=1), docs)

    @staticmethod
    def _dense(members: np.ndarray, docs: int) -> np.ndarray:
        """Whether a bit per document is shorter than 16 bits per member."""
        return members * 16 > docs

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """(entry, document) of every bit that is set."""
        dense = self._dense(self.members, self.docs)
        short = np.flatnonzero(~dense)
        row, doc = np.nonzero(np.unpackbits(self.bits, axis=1, count=self.docs)) if len(self.bits) else (np.zeros(0, np.int64),) * 2
        entry = np.concatenate([np.repeat(short, self.members[short]), np.flatnonzero(dense)[row]])
        return entry, np.concatenate([self.places.astype(np.int64), doc])

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, documents, links): popcounts of the planes' union and of the planes."""
        pairs, nth = np.unique(self.pair, return_inverse=True)
        entry, doc = self.postings()
        union = np.unique(nth[entry] * np.int64(self.docs or 1) + doc)
        links = np.zeros(len(pairs), np.int64)
        np.add.at(links, nth, self.members << self.digit)
        return pairs, np.bincount(union // (self.docs or 1), minlength=len(pairs)), links

    def pack(self) -> list[bytes]:
        return [
            self.pair.astype(np.uint32).tobytes(), self.digit.astype(np.uint8).tobytes(), self.members.astype(np.uint16).tobytes(),
            self.places.tobytes(), self.bits.tobytes(),
        ]

    @classmethod
    def unpack(cls, docs: int, pair: bytes, digit: bytes, members: bytes, places: bytes, bits: bytes) -> "Planes":
        wide = (docs + 7) // 8
        return cls(
            np.frombuffer(pair, np.uint32).astype(np.int64), np.frombuffer(digit, np.uint8).astype(np.int64),
            np.frombuffer(members, np.uint16).astype(np.int64), np.frombuffer(places, np.uint16),
            np.frombuffer(bits, np.uint8).reshape(-1, wide) if wide else np.zeros((0, 0), np.uint8), docs,
        )


PACKED = ["pair", "digit", "members", "places", "bits"]


def index(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One staged row per block: its documents' own counts, and its planes."""
    rows = docs.select(column(id_col).alias("doc"), column(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc"].dataType
    lists = {"doc": id_type, "n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "groups_sha256": T.StringType()}
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            *(T.StructField(n, T.ArrayType(t)) for n, t in lists.items()),
            *(T.StructField(n, T.BinaryType()) for n in PACKED),
        ]
    )

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bytes_in, n, id_type = Block(), 0, TaskContext.get().partitionId() << 32, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([n], pa.int64())]
            for name, values in block.rows.items():
                kind = id_type if name == "doc" else pa.string() if name == "groups_sha256" else pa.int64()
                columns.append(pa.array([values], pa.list_(kind)))
            columns += [pa.array([p], pa.binary()) for p in block.planes().pack()]
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        for batch in batches:
            for wide in bounded([batch], 1, BLOCK_BYTES // 4):
                for at in range(0, wide.num_rows, BLOCK_DOCS):
                    part = wide.slice(at, BLOCK_DOCS)
                    id_type, texts = part.schema.field(0).type, part.column(1).to_pylist()
                    size = sum(len(t) for t in texts if t)
                    if block.size and (block.size + len(texts) > BLOCK_DOCS or bytes_in + size > BLOCK_BYTES):
                        yield out()
                        block, bytes_in, n = Block(), 0, n + 1
                    block.add(part.column(0).to_pylist(), texts, first, second)
                    bytes_in += size
        if block.size:
            yield out()

    return stage(rows.mapInArrow(build, schema))


def block_counts(blocks: DataFrame) -> DataFrame:
    """(block, pair, documents, links) out of each block's planes, staged."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair, docs, links = Planes.unpack(row["docs"], *(row[n] for n in PACKED)).counts()
                columns = [np.full(len(pair), row["block"], np.int64), pair, docs.astype(np.int64), links]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "pair", "documents", "links"])

    planes = blocks.select("block", F.size("doc").alias("docs"), *PACKED)
    return stage(planes.mapInArrow(count, "block long, pair long, documents long, links long"))


def totals(counts: DataFrame) -> DataFrame:
    """(pair, documents, links, best): corpus-wide counts; ``best`` where no partner of the second id has more links."""
    pairs = stage(counts.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links")))
    second = F.col("pair").bitwiseAND(IDS - 1)
    # At most one row per id of the second vocabulary, of which there are at most IDS.
    top = pairs.groupBy(second.alias("b")).agg(F.max("links").alias("top"))
    return pairs.join(F.broadcast(top), second == F.col("b")).select("pair", "documents", "links", (F.col("links") == F.col("top")).alias("best"))


def pair_counts(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, documents, links, best) of every pair that is linked somewhere."""
    found = totals(block_counts(index(docs, first, second, id_col, text_col)))
    return found.select(
        F.shiftright("pair", 16).alias("a_id"), F.col("pair").bitwiseAND(IDS - 1).alias("b_id"), "documents", "links", "best"
    )


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its tokens, groups and links, and how its links count corpus-wide.

    (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    """
    blocks = index(docs, first, second, id_col, text_col)
    counts = block_counts(blocks)
    known = counts.select("block", "pair").join(totals(counts), "pair").select("block", "pair", "links", "best")
    id_type = blocks.schema["doc"].dataType.elementType
    out = T.StructType(
        [
            T.StructField(id_col, id_type),
            *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
            T.StructField("groups_sha256", T.StringType()),
        ]
    )

    def score(block: pa.Table, known: pa.Table) -> pa.Table:
        row = block.slice(0, 1)
        doc, n_a, n_b, n_groups, sha = (row.column(n).combine_chunks().flatten() for n in ("doc", "n_a", "n_b", "n_groups", "groups_sha256"))
        planes = Planes.unpack(len(doc), *(row.column(n)[0].as_py() for n in PACKED))
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair)
        nth = order[np.searchsorted(pair, planes.pair, sorter=order)] if len(pair) else np.zeros(0, np.int64)
        links, best = known.column("links").to_numpy()[nth], known.column("best").to_numpy()[nth]
        entry, at = planes.postings()
        times = np.int64(1) << planes.digit
        sums = []
        for weight in (times, times * best, times * links):
            total = np.zeros(len(doc), np.int64)
            np.add.at(total, at, weight[entry])
            sums.append(pa.array(total))
        return pa.Table.from_arrays([doc, n_a, n_b, n_groups, *sums, sha], names=out.fieldNames())

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, out)
