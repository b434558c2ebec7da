"""CSV records out of files whose quoted cells may hold line breaks, read in many tasks.

A task that reads a byte range of a file does not know whether it begins inside a quoted cell.  Every range is read on the
assumption that it does not, and reports how it would end for either beginning.  Composed in the order of
the ranges, these two-state functions tell how each range truly begins; only the ranges that were read
wrongly are read again.  Records that cross a range's edge are left as pieces, few per range, and put together by file.

Whole files so need one scan, and a second one of few ranges.  What comes to the driver is the list of
ranges that begin inside a cell, at most 8 bytes per range.  A cell that is never closed runs to the end of its file, and is one record.

Lines end in LF or CRLF.  A line break within a cell stays as it is.  Blank records are left out, also between others.
A quote opens a cell only at its beginning, and two quotes within a quoted cell stand for one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleamline.session import stage

WHOLE, HEAD, MIDDLE, TAIL, HEADER, HEADER_TAIL, RANGE = range(7)
ATTEMPTS = 3

# The rest of a quoted cell; cells that are closed, up to the end of the line or to one that isn't.
_REST = re.compile(r'(?:[^"]++|"")*+"(?!")[^,]*+(?:,|$)')
_CELLS = re.compile(r'(?:(?:"(?:[^"]++|"")*+"(?!")[^,]*+|[^",][^,]*+|(?=,))(?:,|$))*+')

# A line that begins outside a quoted cell and ends outside one, for a matcher without look-ahead.
_CELL = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*)?'
_CLOSED = rf"(?s)\A{_CELL}(?:,{_CELL})*\z"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted cell, or outside, ends inside one."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        rest = _REST.match(line)
        if not rest:
            return True
        at = rest.end()
    return _CELLS.match(line, at).end() < len(line)


class Range:
    """Lines of one byte range become records and pieces, from a given beginning."""

    def __init__(self, file: int, start: int, inside: bool):
        self.file, self.start, self.began = file, start, inside
        self.inside = inside
        self.other: bool | None = not inside  # how the other beginning stands; None once it is the same
        self.open: list[str] = []
        self.begun, self.first = start != 0, start == 0
        self.closed = not inside  # whether a record's end has been seen

    def add(self, lines: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(kinds, records) that these lines end; lines none of which opens a cell stay as they are."""
        if not self.begun and len(lines):
            self.begun = True
            mark = pc.replace_substring(lines.slice(0, 1), "\ufeff", "", max_replacements=1)
            if lines[0].as_py().startswith("\ufeff"):
                lines = pa.concat_arrays([mark, lines.slice(1)])
        quoted = np.asarray(pc.match_substring(lines, '"'))
        opening = np.flatnonzero(quoted & ~np.asarray(pc.match_substring_regex(lines, _CLOSED)))
        self._follow(lines, quoted)
        if not self.inside and not len(opening):
            return self._finished(np.full(len(lines), WHOLE, np.int8), lines)
        texts, opening, quoted = lines.to_pylist(), [*opening.tolist(), len(lines)], quoted.tolist()
        records, kinds, at, k = [], [], 0, 0
        while at < len(texts):
            if not self.inside:
                while opening[k] < at:
                    k += 1
                to = opening[k]
                records += texts[at:to]
                kinds += [WHOLE] * (to - at)
                if to < len(texts):
                    self.inside, self.open = True, [texts[to]]
                at = to + 1
                continue
            line = texts[at]
            self.open.append(line)
            if quoted[at] and not ends_inside(line, True):
                records.append("\n".join(self.open))
                kinds.append(WHOLE if self.closed else HEAD)
                self.inside, self.open, self.closed = False, [], True
            at += 1
        return self._finished(np.array(kinds, np.int8), pa.array(records, pa.string()))

    def _follow(self, lines: pa.Array, quoted: np.ndarray) -> None:
        """How the range would stand if it began the other way; mostly the same after a few quotes."""
        if self.other is not None:
            now = self.inside
            for i in np.flatnonzero(quoted):
                line = lines[int(i)].as_py()
                now, self.other = ends_inside(line, now), ends_inside(line, self.other)
                if now == self.other:
                    self.other = None
                    return

    def _finished(self, kinds: np.ndarray, records: pa.Array) -> tuple[np.ndarray, pa.Array]:
        whole = kinds == WHOLE
        ended = np.asarray(pc.ends_with(records, "\r")) & whole
        if ended.any():
            records = pc.if_else(pa.array(ended), pc.replace_substring_regex(records, r"\r\z", ""), records)
        blank = np.asarray(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(records)), 0)) & whole
        if blank.any():
            kinds, records = kinds[~blank], records.filter(pa.array(~blank))
        if self.first and (kinds == WHOLE).any():
            kinds[np.flatnonzero(kinds == WHOLE)[0]] = HEADER
            self.first = False
        return kinds, records

    def end(self) -> tuple[list[int], list[str]]:
        if not self.open:
            return [], []
        return [(HEADER_TAIL if self.first else TAIL) if self.closed else MIDDLE], ["\n".join(self.open)]


SCHEMA = "file long, start long, kind byte, record string, out_inside boolean, in_inside boolean"
_NAMES = ["file", "start", "kind", "record", "out_inside", "in_inside"]


def _rows(r: Range, kinds, records, ends=(None, None)) -> pa.RecordBatch:
    n = len(kinds)
    columns = [pa.repeat(pa.scalar(r.file, pa.int64()), n), pa.repeat(pa.scalar(r.start, pa.int64()), n)]
    columns += [pa.array(kinds, pa.int8()), pa.array(records, pa.string())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.repeat(pa.scalar(e, pa.bool_()), n) for e in ends)], names=_NAMES)


def _cut(inside: bool):
    """Lines with their file and range to records, pieces and one row per range."""

    def finish(r: Range) -> Iterator[pa.RecordBatch]:
        other = r.inside if r.other is None else r.other
        ends = (other, r.inside) if r.began else (r.inside, other)
        yield _rows(r, *r.end())
        yield _rows(r, [RANGE], [None], ends)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            edges = [0, *_changes(batch), batch.num_rows]
            for at, to in zip(edges, edges[1:]):
                if at == to:
                    continue
                file, start = batch.column(1)[at].as_py(), batch.column(2)[at].as_py()
                if now is None or (now.file, now.start) != (file, start):
                    if now is not None:
                        yield from finish(now)
                    now = Range(file, start, inside)
                yield _rows(now, *now.add(batch.column(0).slice(at, to - at)))
        if now is not None:
            yield from finish(now)

    return run


def _changes(batch: pa.RecordBatch) -> list[int]:
    """Rows that begin another range than the row before."""
    if batch.num_rows < 2:
        return []
    n, key = batch.num_rows - 1, [batch.column(i) for i in (1, 2)]
    differs = pc.or_(*(pc.not_equal(k.slice(1), k.slice(0, n)) for k in key))
    return [i + 1 for i in pc.indices_nonzero(differs).to_pylist()]


def range_key() -> Column:
    return F.xxhash64("file", "start")


def inside_ranges(ranges: DataFrame) -> DataFrame:
    """(file, start) of the ranges that begin inside a cell.

    A range keeps, swaps or sets the state.  The state before a range is what the last setting one left,
    swapped once per swapping range since.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    swap = F.when(F.col("out_inside") & ~F.col("in_inside"), 1).otherwise(0)
    known = ranges.withColumn("swaps", F.sum(swap).over(upto))
    left = F.when(F.col("out_inside") == F.col("in_inside"), F.struct(F.col("out_inside").cast("int").alias("state"), "swaps"))
    known = known.withColumns(
        {"left": F.last(left, ignorenulls=True).over(before), "swapped": F.coalesce(F.max("swaps").over(before), F.lit(0))}
    )
    state = F.coalesce(F.col("left.state"), F.lit(0)) + F.col("swapped") - F.coalesce(F.col("left.swaps"), F.lit(0))
    return known.filter(state % 2 == 1).select("file", "start")


def read_records(spark: SparkSession, path: str, shape=None) -> DataFrame:
    """``record`` per CSV record below the header, staged; ``shape`` makes another column of it before it is written."""
    shape = shape or (lambda record: record)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )

    def read(rows: DataFrame, inside: bool) -> DataFrame:
        cut = rows.mapInArrow(_cut(inside), SCHEMA)
        done = F.col("kind") == WHOLE
        return stage(cut.withColumn("out", F.when(done, shape(F.col("record")))).withColumn("record", F.when(~done, F.col("record"))))

    for _ in range(ATTEMPTS):
        first = read(lines, False)
        wrong = [r["key"] for r in inside_ranges(first.filter(F.col("kind") == RANGE)).select(range_key().alias("key")).collect()]
        parts = [first]
        if wrong:
            again = read(lines.filter(range_key().isin(wrong)), True)
            if again.filter(F.col("kind") == RANGE).count() != len(wrong):
                continue  # the scan was cut into other ranges than before
            parts = [first.filter(~range_key().isin(wrong)), again]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        whole = rows.filter(F.col("kind") == WHOLE).select(F.col("out").alias("record"))
        return whole.unionByName(_joined(rows).select(shape(F.col("record")).alias("record")))
    raise RuntimeError(f"the ranges of {path} changed between two scans, {ATTEMPTS} times")


def _joined(rows: DataFrame) -> DataFrame:
    """Records of which pieces lie in several ranges."""
    pieces = rows.filter(F.col("kind").isin(HEAD, MIDDLE, TAIL, HEADER_TAIL))
    opens = F.col("kind").isin(TAIL, HEADER_TAIL)
    chain = F.sum(opens.cast("int")).over(Window.partitionBy("file").orderBy("start", "kind"))
    part = F.struct("start", "kind", "record")
    joined = pieces.withColumn("chain", chain).groupBy("file", "chain").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["record"]), "\n").alias("record"),
        F.max((F.col("kind") == HEADER_TAIL).cast("int")).alias("header"),
    )
    return joined.filter(F.col("header") == 0).select(F.regexp_replace("record", r"\r\z", "").alias("record"))
