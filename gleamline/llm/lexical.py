"""Ranked lexical search: many items at once, with common subexpressions evaluated once.

An item's score is a sum over its terms, so items that share terms share parts of their sums.  The items' terms,
commonest first, are mined for neighbours that several items share; the commonest pairs become nodes, round after
round, until no pair of neighbours is in two items.  The nodes form a directed graph without cycles whose leaves
are terms and whose roots are the items.  Documents are scored in short blocks: each node's accumulator
(one whole number per document) is added up once, from its two parts, and each item adds the accumulators it ends in.

Documents are read once for the items' terms; term and corpus counts are aggregates over what was read.  Every
task keeps the best documents of each item it has seen, and the rest meet by item and run of documents, then by item.

Items are a stated query set.  They are taken in blocks of ``ITEM_CHARS`` characters of different texts, so the terms,
counts and graph that go to every task are bounded however many items there are.

Defined cases: a null text has no terms, and an item without terms no rows.  Repeated document rows are documents of
their own; equal scores stand by identifier, null last, and rows equal in both in any order.  Repeated items are ranked
each.  A long text is read whole, its terms being counted one block of it after the other.  Empty tables give no rows.
Identifiers keep their types; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleamline.llm.common import bounded, column, run_count, run_of
from gleamline.session import stage

TOP = 20
ITEM_CHARS = 1 << 20
ACCUMULATOR_BYTES = 32 << 20
TEXT_BYTES = 4 << 20

# Bytes that aren't a digit, an ASCII letter or part of another character end a term; only A-Z are lower-cased.
_LOWER = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 0x20
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


@dataclass(frozen=True)
class Graph:
    """Leaves are (term, times in an item); node ``i`` after them adds two earlier nodes; roots are the items'."""

    leaves: list[tuple[bytes, int]]
    nodes: list[tuple[int, int]]
    roots: list[list[int]]

    def additions(self) -> int:
        return len(self.nodes) + sum(max(0, len(r) - 1) for r in self.roots)

    def expanded(self, item: int) -> list[tuple[bytes, int]]:
        out, left = [], list(self.roots[item])
        while left:
            n = left.pop()
            if n < len(self.leaves):
                out.append(self.leaves[n])
            else:
                left += self.nodes[n - len(self.leaves)]
        return sorted(out)

    def levels(self) -> list[np.ndarray]:
        """Nodes that can be added up together, after those of the levels before."""
        depth = [0] * len(self.leaves)
        for a, b in self.nodes:
            depth.append(1 + max(depth[a], depth[b]))
        depths = np.array(depth, np.int64)
        return [np.flatnonzero(depths == d) for d in range(1, max(depth, default=0) + 1)]


def share(items: list[list[bytes]]) -> Graph:
    """The graph of items given as their terms, repeats included.

    A round counts pairs of neighbours, an item once, and replaces those in two items or more, the commonest first.
    Its memory is that of the items' terms.
    """
    counted = [Counter(terms) for terms in items]
    held = Counter(leaf for c in counted for leaf in c.items())
    leaves = sorted(held, key=lambda leaf: (-held[leaf], leaf))
    number = {leaf: i for i, leaf in enumerate(leaves)}
    rows = [sorted(number[leaf] for leaf in c.items()) for c in counted]
    nodes: list[tuple[int, int]] = []
    while True:
        pairs = Counter(p for row in rows for p in set(zip(row, row[1:])))
        shared = {p: (-n, p) for p, n in pairs.items() if n > 1}
        if not shared:
            return Graph(leaves, nodes, rows)
        named: dict[tuple[int, int], int] = {}
        for i, row in enumerate(rows):
            out, at = [], 0
            while at < len(row):
                here, after = shared.get((*row[at : at + 2],)), shared.get((*row[at + 1 : at + 3],))
                if here is None or (after is not None and after < here):
                    out.append(row[at])
                    at += 1
                else:
                    pair = (row[at], row[at + 1])
                    if pair not in named:
                        named[pair] = len(leaves) + len(nodes)
                        nodes.append(pair)
                    out.append(named[pair])
                    at += 2
            rows[i] = out


def counted(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, times), staged: each row's number of terms, and its places in ``terms`` with their counts."""
    rows = docs.select(column(id_col).alias("doc"), column(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc", rows.schema["doc"].dataType), T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType())),
        ]
    )
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 1, TEXT_BYTES):
            sizes, found, times = [], [], []
            for text in part.column(1).to_pylist():
                c: Counter = Counter()
                for piece in _pieces(text):
                    c.update(piece)
                sizes.append(c.total())
                hits = [(number[t], k) for t, k in c.items() if t in number]
                found.append([t for t, _ in hits])
                times.append([k for _, k in hits])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                names=schema.fieldNames(),
            )

    return stage(rows.mapInArrow(run, schema))


def _pieces(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, of ``size`` bytes at a time."""
    data = (text or "").encode().translate(_LOWER)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + size)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def _scores(graph: Graph, weights: np.ndarray, docs: int, length: int, n, doc, term, times) -> np.ndarray:
    """(items, documents): the scores of the documents whose sizes are ``n``; postings are (doc, term, times)."""
    norm = 75 + (25 * n * docs) // length
    parts = weights[term] * ((1_000_000_000 * times) // (1000 * times + 12 * norm[doc]))
    by_term = np.zeros((len(weights), len(n)), np.int64)
    by_term[term, doc] = parts
    place = {t: i for i, t in enumerate(sorted({t for t, _ in graph.leaves}))}
    acc = np.zeros((len(graph.leaves) + len(graph.nodes), len(n)), np.int64)
    acc[: len(graph.leaves)] = by_term[[place[t] for t, _ in graph.leaves]] * np.array([k for _, k in graph.leaves], np.int64)[:, None]
    two = np.array(graph.nodes, np.int64).reshape(-1, 2)
    for level in graph.levels():
        left, right = two[level - len(graph.leaves)].T
        acc[level] = acc[left] + acc[right]
    return np.stack([acc[r].sum(axis=0) for r in graph.roots])


def _best(rows: DataFrame, keys: list[str], graph: Graph, weights: np.ndarray, docs: int, length: int, top: int) -> DataFrame:
    """(key, doc, score): each task's best documents of each item."""
    kind = rows.schema["doc"].dataType
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])
    wide = len(weights) + len(graph.leaves) + len(graph.nodes) + len(graph.roots)
    short = max(16, ACCUMULATOR_BYTES // (8 * max(1, wide)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in graph.roots]
        least, id_type = np.ones(len(best), np.int64), None
        for batch in batches:
            for at in range(0, batch.num_rows, short):
                part = batch.slice(at, short)
                id_type, ids = part.schema.field(0).type, part.column(0).to_pylist()
                n = np.asarray(part.column(1), np.int64)
                lists = part.column(2)
                doc = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths(), np.int64))
                scores = _scores(
                    graph, weights, docs, length, n, doc, np.asarray(lists.flatten(), np.int64), np.asarray(part.column(3).flatten(), np.int64)
                )
                for i in np.flatnonzero((scores >= least[:, None]).any(axis=1)):
                    hits = np.flatnonzero(scores[i] >= least[i])
                    best[i] = sorted(
                        best[i] + [(-int(scores[i, d]), ids[d] is None, ids[d]) for d in hits], key=lambda x: x[:2] if x[1] else x
                    )[:top]
                    if len(best[i]) == top:
                        least[i] = -best[i][-1][0]
        if id_type is not None:
            flat = [(keys[i], d, -s) for i, found in enumerate(best) for s, _, d in found]
            columns = zip(*flat) if flat else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), id_type, pa.int64()))], names=schema.fieldNames()
            )

    return rows.mapInArrow(run, schema)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows by item, first within runs of documents, so that no task sorts all tasks' rows of an item."""
    runs = run_count(found.sparkSession)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    near = Window.partitionBy("key", run_of(F.col("doc"), runs)).orderBy(*order)
    close = found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top)
    return close.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", item_col: str = "item_id",
    text_col: str = "text", item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """The ``top`` best documents of every item: (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    asked = stage(
        items.select(column(item_col).alias("item_id"), F.coalesce(column(text_col), F.lit("")).alias("text")).withColumn(
            "key", F.sha2("text", 256)
        )
    )
    # Equal items are searched for once.
    texts = asked.groupBy("key").agg(F.first("text").alias("text"))
    blocks = max(1, math.ceil((texts.agg(F.sum(F.length("text"))).first()[0] or 0) / item_chars))
    found = []
    for b in range(blocks):
        of_block: Column = F.pmod(F.xxhash64("key"), F.lit(blocks)) == b
        part = sorted((r["key"], terms_of(r["text"])) for r in texts.filter(of_block).collect())  # about item_chars characters
        part = [(k, t) for k, t in part if t]
        if part:
            found.append(_block(docs, [k for k, _ in part], [t for _, t in part], top, id_col, text_col))
    kind = docs.select(column(id_col)).schema[0].dataType
    if not found:
        schema = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])
        found = [spark.createDataFrame([], schema.add("key", T.StringType()))]
    hits = functools.reduce(DataFrame.unionByName, found)
    return asked.join(hits, "key").select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _block(docs: DataFrame, keys: list[str], items: list[list[bytes]], top: int, id_col: str, text_col: str) -> DataFrame:
    """(key, rank, doc, score) of one block of items."""
    graph = share(items)
    terms = sorted({t for t, _ in graph.leaves})
    rows = counted(docs, terms, id_col, text_col)
    whole = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(terms), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most one row per term of the block
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * whole["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    some = rows.filter(F.size("terms") > 0)
    best = _best(some, keys, graph, weights, whole["docs"], whole["length"], top)
    return _ranked(best, top).select("key", "rank", "doc", "score")
