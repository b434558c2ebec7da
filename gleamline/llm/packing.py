"""Best-fit packing of tokenised documents into sequences, by bin completion.

Every document becomes its token ids and an end token; longer ones than a sequence are cut.  The
number of pieces of each length is all the packing needs: at most as many numbers as a sequence has
tokens, whatever the table's size.  Branch and bound over that histogram (``binfill``) gives fillings
and how often each is used.  Pieces of one length are alike, so a piece's place follows from its rank
among them.  Ranks are counted per run of documents and summed over the runs, so a length that a third
of all pieces have isn't ranked in one task.

Defined cases: a null or empty text is its end token alone.  Rows that repeat are packed each.  Null
identifiers are passed on.  An empty table gives no rows.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleamline.llm.binfill import Solution, complete
from gleamline.llm.bpe import encoder
from gleamline.llm.common import bounded, column, run_count, run_of
from gleamline.session import stage


def pieces(
    docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids: every document cut into pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "ids")
        for part in bounded(batches, 1, 4 << 20):
            joined, ends = enc.encode(part.column(1))
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                doc = bytes(joined[a:b]) + end
                for k, at in enumerate(range(0, len(doc), 4 * size)):
                    ids = doc[at : at + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(ids) // 4)
                    crc.append(zlib.crc32(ids))
                    if with_ids:
                        raw.append(ids)
            columns = [
                part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


class Places:
    """Where the pieces of each length go: arrays as long as the solution has parts."""

    def __init__(self, counts: dict[int, int], size: int, solution: Solution):
        self.base = np.zeros(size + 2, np.int64)
        for s, n in counts.items():
            self.base[s + 1] = n
        self.base = np.cumsum(self.base)
        used = dict.fromkeys(counts, 0)
        parts, first = [], 0
        for filling, times in solution:
            at = 0
            for s, k in filling:
                parts.append((int(self.base[s]) + used[s], k, first, at))
                used[s] += k * times
                at += s * k
            first += times
        parts.sort()
        self.begin, self.each, self.first, self.at = np.array(parts or [(0, 1, 0, 0)], np.int64).T

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        nth = self.base[length] + rank
        i = np.searchsorted(self.begin, nth, "right") - 1
        bin_, slot = np.divmod(nth - self.begin[i], self.each[i])
        return self.first[i] + bin_, self.at[i] + slot * length


def pack(cut: DataFrame, size: int = 2048, steps: int = 4_000) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32, ...) with ``sequence_id`` and ``offset``.

    ``cut`` is read several times and should be a written table.
    """
    spark = cut.sparkSession
    rank, before, run = "__rank", "__before", "__run"
    rows = cut.withColumn(run, run_of(F.col("doc_id"), run_count(spark)))
    # At most size x runs rows, then at most size rows: bounds that no table's growth moves.
    cells = stage(rows.groupBy("length", run).agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(counts, size, complete(counts, size, steps=steps)))
    earlier = Window.partitionBy("length").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", run, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    local = Window.partitionBy("length", run).orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        rows.withColumn(rank, (F.row_number().over(local) - 1).cast("long"))
        .join(offsets, ["length", run])
        .select(*cut.columns, (F.col(rank) + F.col(before)).alias(rank))
    )

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = places.value
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("length")))
            nth = np.asarray(batch.column(batch.num_columns - 1))
            sequence, offset = where.of(length, nth)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    added = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
    return ranked.mapInArrow(place, T.StructType([*cut.schema, *added]))


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    return pack(stage(pieces(docs, path, size, end_id, with_ids)), size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences, from ``pack_documents(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )
