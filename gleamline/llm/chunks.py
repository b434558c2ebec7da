"""Repeated passages by content-defined chunking with a gear rolling hash.

A gear hash over the last ``WINDOW`` bytes is rolled over the whole text; a chunk ends where the hash is
the smallest of some ``SPAN`` bytes around it, which depends on the bytes near it alone.  The ``SEED`` bytes
before each end are deduplicated by a digest: the first occurrence by identifier and place stays.

Fifty words have ``SEED + SPAN - 1`` bytes at least, so whatever their lengths, two texts that share them
share a whole window of ``SPAN`` places, the end chosen in it and the seed before that.  A repeated seed is
set beside the first text that holds it, or beside its last occurrence in the same text; seeds at the same
distance that meet are one piece.  Its bytes are compared with that text's before and behind, on to the
first difference, and what then has ``words`` words or more is reported, overlapping passages as one.

The first text with a seed need not hold the whole passage.  Two texts that share more with each other than
with that first one differ from it at the same place and by the same byte there.  Where comparisons end
alike, every window of ``words`` whole words over that end is deduplicated by a digest of 128 bits, so that
a passage of ``words`` whole words is found whichever texts hold parts of it before.  Ends more than ``FAR``
bytes from a piece's seeds may stay unknown where the piece lies within a longer run of passages.

Only digests, identifiers and places are shuffled for all chunks; texts only meet the places at which they
are to be compared.  A chunk that a third of all texts hold is counted in each task first; in the join
back to the texts each digest has one row on one side, which Spark splits.

Defined cases: a null or empty text has no chunks, and a text below ``SEED + SPAN - 1`` bytes no 50 words to
repeat; with fewer ``words`` asked for, passages below those bytes may have no seed.  Rows that repeat are
texts of their own at the same
places: of rows equal in identifier, place and digest the first one counted stays, so identical rows are
no repeats of each other.  Null identifiers are never first and have no row in the report.  An empty table
gives no rows; other columns are passed on by ``remove`` and otherwise ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleamline.llm.common import bounded, column, fresh, slices
from gleamline.session import scratch, stage

WINDOW = 16
SPAN = 52
SEED = 48
WORDS = 50
#: No byte of a shared passage is further than this from its first or last shared seed.
NEAR = SPAN + 3
#: Bytes compared before and behind a piece at first, and how many times more where that shows no difference.
REACH = 64
FARTHER = 8
#: Bytes from which on only the outermost of overlapping passages are compared farther.
FAR = 512
#: What is counted of a seed: the words that begin in it, and within ``NEAR`` before and after it.
SIZES = ("words", "before", "after")
#: Bits for each: so few bytes hold fewer than 32 words.
BITS = 5

#: A fixed random number for each byte, made by a multiplicative rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
GEAR ^= GEAR >> np.uint32(15)


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the last ``WINDOW`` bytes' gears, shifted by their age."""
    h, width = GEAR[raw], 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h = h + older
        width *= 2
    return h


def boundaries(raw: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Ends of the chunks of a text: the places of the smallest hash in each ``span`` bytes, and its end."""
    n = len(raw)
    if n <= span:
        return np.array([n] if n else [], np.int64)
    # The later of equal hashes counts as the smaller one.
    key = (gear(raw).astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    low, width = key, 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    at = np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))
    ends = np.append(at.astype(np.int64) + 1, n)
    padded = np.append(raw, np.zeros(4, np.uint8))
    for _ in range(3):  # no chunk ends within a character
        ends += (padded[ends] & 0xC0) == 0x80
    return ends[np.append(True, ends[1:] != ends[:-1])]


def seeds_of(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the texts between ``edges`` each seed is in, and where in ``raw`` it begins and ends."""
    long = np.flatnonzero(np.diff(edges) >= SEED + SPAN - 1)
    found = [boundaries(raw[a:b]) + a for a, b in zip(edges[long].tolist(), edges[long + 1].tolist())]
    row = np.repeat(long, [len(ends) for ends in found])
    ends = np.concatenate([np.zeros(0, np.int64), *found])
    whole = ends >= edges[row] + SEED
    row, ends = row[whole], ends[whole]
    begins = ends - SEED
    for _ in range(3):  # no seed begins within a character
        begins += (raw[begins] & 0xC0) == 0x80
    return row, begins, ends


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, sizes, digest): every seed of every text.

    ``at`` holds the seed's first byte and the words that begin before it, ``sizes`` its bytes and the
    counts named in ``SIZES``, each in a few bits of one number, as every seed of every text is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 1, 4 << 20):
            texts = pc.fill_null(part.column(1).cast(pa.large_string()), "")
            _, offsets, data = texts.buffers()
            edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
            edges = edges - edges[0]
            row, begins, ends = seeds_of(raw, edges)
            if not len(row):
                continue
            blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
            first = ~blank
            first[1:] &= blank[:-1]
            opens = edges[row]
            first[opens] = ~blank[opens]
            count = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(first, out=count[1:])
            counts = {
                "words": count[ends] - count[begins],
                "before": count[begins] - count[np.maximum(begins - NEAR, opens)],
                "after": count[np.minimum(ends + NEAR, edges[row + 1])] - count[ends],
            }
            sizes = sum((counts[name] << (BITS * k) for k, name in enumerate(SIZES)), (SEED - (ends - begins)) << (BITS * len(SIZES)))
            text, digest = raw.tobytes(), xxhash.xxh3_64_digest
            digests = [digest(text[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row)), pa.array(((begins - opens) << 32) | (count[begins] - count[opens])),
                    pa.array(sizes.astype(np.int32)), pa.array(np.frombuffer(b"".join(digests), np.int64)),
                ],
                names=["id", "at", "sizes", "digest"],
            )

    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, at long, sizes int, digest long")


def size_of(name: str) -> Column:
    """One of the counts in ``sizes``."""
    return F.shiftright("sizes", BITS * SIZES.index(name)).bitwiseAND((1 << BITS) - 1)


def repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, n_words, keep_ids): repeated passages, in bytes, and whose seeds they repeat.

    ``keep_ids`` are the texts that hold the passage's seeds first.
    """
    with scratch(cut(docs, id_col, text_col)) as chunks:
        open_ = stage(_pieces(chunks, words))
    done, reach = None, REACH
    while True:
        with scratch(_surroundings(docs, open_, reach, id_col, text_col)) as around:
            found = _extended(open_, around, reach)
            found = stage(_judged(found if done is None else found.unionByName(done), words, reach))
        open_, done = found.filter("more").drop("more"), found.filter("NOT more").drop("more")
        if open_.isEmpty():
            break
        reach *= FARTHER
    told = ["id", "keep_ids", "start", "end", "first", "upto"]
    enough = done.filter(F.col("upto") - F.col("first") >= words).select(told)
    with scratch(_windows(docs, _shared_ends(done), words, id_col, text_col)) as windows:
        others = stage(_repeated(windows, words).select(told))
    return _united(enough.unionByName(others)).select(F.col("id").alias(id_col), "start", "end", "n_words", "keep_ids")


def _pieces(chunks: DataFrame, words: int) -> DataFrame:
    """(id, keep_ids, with_id, apart, start, end, first, upto): repeated seeds that meet, and what to compare them with.

    ``apart`` bytes before is the same in the text ``with_id``; ``first`` and ``upto`` are the words that
    begin before ``start`` and before ``end``.  Left out is what cannot have ``words`` words with all
    that is repeated next to it.
    """
    start = F.shiftright("at", 32).cast("int")
    place = F.struct("id", start.alias("start"))
    # Written, so that both sides of the join come from plain shuffles, whose hot parts Spark can split.
    first = stage(
        chunks.groupBy("digest")
        .agg(F.min(place).alias("keep"), F.max(place).alias("last"))
        .filter("keep != last")
        .select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.start").alias("keep_start"))
    )
    itself = F.col("id").eqNullSafe(F.col("keep_id")) & (start == F.col("keep_start"))
    again = chunks.join(first, "digest").filter(~itself)
    # One shuffle by text serves all that follows.
    order = Window.partitionBy("id").orderBy("start")
    same = Window.partitionBy("id", "digest").orderBy("start")
    side = Window.partitionBy("id", "with_id", "apart").orderBy("start")
    near = Window.partitionBy("id", "cluster")
    # What goes over the ends of seeds that meet holds the first or the last of them: these are set beside both.
    by_first = F.struct(F.col("keep.keep_id").alias("with_id"), (F.col("start") - F.col("keep.keep_start")).alias("apart"))
    by_own = F.struct("with_id", "apart")
    outermost = F.coalesce((F.col("start") > F.lag("end").over(side)) | (F.lead("start").over(side) > F.col("end")), F.lit(True))
    both = F.col("own").isNotNull() & F.col("outermost")
    begun, last = F.col("first") - F.col("before"), F.col("upto") + F.col("after")
    return (
        again.repartition("id")
        .groupBy("id", "at", "sizes", "digest")
        .agg(F.min(F.struct("keep_id", "keep_start")).alias("keep"))
        .withColumns({"start": start, "first": F.col("at").bitwiseAND(0xFFFFFFFF).cast("int"), **{name: size_of(name) for name in SIZES}})
        .withColumns({"upto": F.col("first") + F.col("words"), "end": F.col("start") + SEED - F.shiftright("sizes", BITS * len(SIZES))})
        .withColumn("new", F.coalesce(F.col("start") - F.lag("start").over(order) > NEAR + 3, F.lit(True)).cast("int"))
        .withColumn("cluster", F.sum("new").over(order))
        .withColumn("may", F.max(last).over(near) - F.min(begun).over(near))
        # A seed that the text has again and again is set beside the one before, so that all are at one distance.
        .withColumn("own", F.lag("start").over(same))
        .filter(F.col("may") >= words)
        .withColumns({"with_id": F.when(F.col("own").isNull(), F.col("keep.keep_id")).otherwise(F.col("id")), "apart": F.col("start") - F.coalesce("own", "keep.keep_start")})
        .withColumn("outermost", outermost)
        .withColumn("beside", F.explode(F.when(both, F.array_distinct(F.array(by_own, by_first))).otherwise(F.array(by_own))))
        .withColumns({"with_id": F.col("beside.with_id"), "apart": F.col("beside.apart")})
        .withColumn("new", F.coalesce(F.col("start") > F.lag("end").over(side), F.lit(True)).cast("int"))
        .withColumn("piece", F.sum("new").over(side))
        .groupBy("id", "with_id", "apart", "piece")
        .agg(
            F.collect_set("keep.keep_id").alias("keep_ids"), F.min("start").alias("start"), F.max("end").alias("end"),
            F.min("first").alias("first"), F.max("upto").alias("upto"),
        )
        .drop("piece")
    )


def _merged(pieces: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """``pieces`` with those of the same ``by`` that overlap as one."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        pieces.withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(order))
        .groupBy(*by, "run")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("keep_ids")))).alias("keep_ids"), F.min_by("first", "start").alias("first"),
            F.max("upto").alias("upto"), *more, F.min("start").alias("start"), F.max("end").alias("end"),
        )
        .drop("run")
    )


def _judged(pieces: DataFrame, words: int, reach: int) -> DataFrame:
    """``pieces`` at one distance that overlap as one, and with ``more`` where the comparison has to go on.

    That is where it met no difference at an end.  From ``FAR`` bytes on, a piece inside a longer run of
    passages that has enough words by itself is left as it is, with an end that isn't known.
    """
    left, right = F.struct("start", "left"), F.struct("end", ~F.col("right"))
    ends = [F.min_by(c, left).alias(c) for c in ("left", "left_end")] + [F.max_by(c, right).alias(c) for c in ("right", "right_end")]
    whole = _merged(pieces.repartition("id"), ["id", "with_id", "apart"], *ends)
    unknown = F.col("left") | F.col("right")
    if reach < FAR:
        return whole.withColumn("more", unknown)
    order = Window.partitionBy("id", "enough").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = Window.partitionBy("id", "enough", "run")
    outer = (F.col("left") & (F.col("start") == F.min("start").over(run))) | (F.col("right") & (F.col("end") == F.max("end").over(run)))
    return (
        whole.withColumn("enough", (F.col("upto") - F.col("first")) >= words)
        .withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(order))
        .withColumn("more", unknown & (~F.col("enough") | outer))
        .drop("enough", "new", "run")
    )


def _shared_ends(pieces: DataFrame) -> DataFrame:
    """(id, at): where several pieces that repeat the same bytes of a text end alike.

    Texts that share more than the piece differ from that text at the same place, and by the same byte.
    """
    end = [
        F.struct(F.lit(side).alias("side"), F.col(name).alias("end"), F.col(at).alias("at"))
        for side, name, at in ((0, "left_end", "start"), (1, "right_end", "end"))
    ]
    key = ["with_id", "side", "end"]
    ends = (
        pieces.select("id", "with_id", "apart", F.explode(F.array(*end)).alias("e"))
        .filter("e.end IS NOT NULL")
        .select("id", "with_id", "e.side", (F.col("e.end") - F.col("apart").cast("long") * 256).alias("end"), "e.at")
    )
    alike = stage(ends.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key))
    return ends.join(alike, key).select("id", "at")


def _windows(docs: DataFrame, ends: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, end, first, digest): each window of ``words`` whole words that goes over one of ``ends``."""
    texts = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 1, 4 << 20):
            for i, (text, places) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                data = (text or "").encode()
                raw = np.frombuffer(data, np.uint8)
                blank = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
                turns = np.flatnonzero(blank[1:] != blank[:-1])
                begins, ends_ = turns[::2], turns[1::2]
                n = len(begins) - words + 1
                if n < 1:
                    continue
                at = np.array(places, np.int64)
                low = np.searchsorted(ends_[words - 1 :], at, "right")
                high = np.maximum(np.minimum(np.searchsorted(begins, at, "left"), n), low)
                marks = np.zeros(n + 1, np.int64)
                np.add.at(marks, low, 1)
                np.add.at(marks, high, -1)
                first = np.flatnonzero(np.cumsum(marks[:n]))
                lo, hi = begins[first], ends_[first + words - 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.full(len(first), i))), *(pa.array(x.astype(np.int32)) for x in (lo, hi, first)),
                        pa.array([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(lo.tolist(), hi.tolist())], pa.binary()),
                    ],
                    names=["id", "start", "end", "first", "digest"],
                )

    # A text has two ends a piece at most, and no more pieces than seeds and their copies in it.
    places = ends.groupBy("id").agg(F.collect_set("at").alias("places"))
    return texts.join(places, "id").mapInArrow(run, f"id {kind}, start int, end int, first int, digest binary")


def _repeated(windows: DataFrame, words: int) -> DataFrame:
    """The windows that are not the first with their words, as pieces."""
    place = F.struct("id", "start")
    kept = windows.groupBy("digest").agg(F.min(place).alias("keep"), F.max(place).alias("last")).filter("keep != last").select("digest", "keep")
    again = windows.join(kept, "digest").filter(place != F.col("keep"))
    return again.withColumns({"keep_ids": F.array("keep.id"), "upto": F.col("first") + words})


def _united(passages: DataFrame) -> DataFrame:
    """Passages of a text that overlap as one."""
    return _merged(passages.repartition("id"), ["id"]).withColumn("n_words", (F.col("upto") - F.col("first")).cast("long"))


def _surroundings(docs: DataFrame, pieces: DataFrame, reach: int, id_col: str, text_col: str) -> DataFrame:
    """(id, at, inner, before, behind): a digest of each place in ``pieces``, and ``reach`` bytes on either side."""
    mine = pieces.select("id", F.array("start", "end").alias("at"))
    theirs = pieces.select(F.col("with_id").alias("id"), F.array(F.col("start") - F.col("apart"), F.col("end") - F.col("apart")).alias("at"))
    # A text has no more places than chunks, whoever repeats them.
    places = mine.unionByName(theirs).groupBy("id").agg(F.collect_set("at").alias("places"))
    texts = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 1, 4 << 20):
            for i, (text, places_) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                data = (text or "").encode()
                step = max(1, (4 << 20) // reach)
                for some in (places_[j : j + step] for j in range(0, len(places_), step)):
                    # The piece's own first and last byte are with what is before and behind.
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array([i] * len(some), pa.int64())), pa.array(some, pa.list_(pa.int32())),
                            pa.array([xxhash.xxh3_128_digest(data[lo:hi]) for lo, hi in some], pa.binary()),
                            pa.array([data[max(0, lo - reach) : lo + 1] for lo, _ in some], pa.binary()),
                            pa.array([data[hi - 1 : hi + reach] for _, hi in some], pa.binary()),
                        ],
                        names=["id", "at", "inner", "before", "behind"],
                    )

    around = texts.join(places, "id").mapInArrow(run, f"id {kind}, at array<int>, inner binary, before binary, behind binary")
    sides = F.min(F.struct("inner", "before", "behind")).alias("s")
    return around.groupBy("id", "at").agg(sides).select("id", "at", "s.*")


def _extended(pieces: DataFrame, around: DataFrame, reach: int) -> DataFrame:
    """``pieces`` with the bytes before and behind, ``reach`` at most, that are as in the text they repeat.

    ``left`` and ``right`` tell whether there was no difference; ``left_end`` and ``right_end`` hold the place
    and the byte of the difference, and are null at the text's own beginning or end.
    """
    kind = pieces.schema["id"].dataType.simpleString()
    own = around.select("id", F.col("at")[0].alias("start"), F.col("at")[1].alias("end"), "inner", "before", "behind")
    other = around.select(
        F.col("id").alias("with_id"), F.col("at")[0].alias("with_start"), F.col("at")[1].alias("with_end"),
        F.col("inner").alias("with_inner"), F.col("before").alias("with_before"), F.col("behind").alias("with_behind"),
    )
    given = ["id", "keep_ids", "with_id", "apart", "start", "end", "first", "upto"]
    pairs = (
        pieces.select(*given).join(own, ["id", "start", "end"])
        .withColumns({"with_start": F.col("start") - F.col("apart"), "with_end": F.col("end") - F.col("apart")})
        .join(other, ["with_id", "with_start", "with_end"])
        .filter("inner = with_inner")
        .select(*given, "before", "with_before", "behind", "with_behind")
    )

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max(1, (4 << 20) // reach)):
            out = []
            for lo, hi, first, upto, a, b, c, d in zip(*(part.column(i).to_pylist() for i in range(4, 12))):
                k, left = _common(a[::-1], b[::-1]), False
                differs = (lo - k) * 256 + a[-k - 1] if k < len(a) else None
                if k == reach + 1:
                    k, left = k - 1, True
                while k > 1 and a[-k] & 0xC0 == 0x80:
                    k -= 1
                # A word counts where it begins; one that began before the match in either text doesn't.
                both = a[-k] not in _BLANK and all(len(x) == k or x[-k - 1] in _BLANK for x in (a, b))
                begins = a[-1] not in _BLANK and (len(a) == 1 or a[-2] in _BLANK)
                first += begins - both - _begun(a[len(a) - k :])
                m = _common(c, d)
                differs_too = (hi - 1 + m) * 256 + c[m] if m < len(c) else None
                right = m == reach + 1
                while m > 1 and m < len(c) and c[m] & 0xC0 == 0x80:  # not into a character
                    m -= 1
                if right and m > 1:  # the next byte isn't known
                    while m > 1 and c[m - 1] & 0xC0 == 0x80:
                        m -= 1
                    m -= m > 1
                out.append((lo - k + 1, hi + m - 1, first, upto + _begun(c[:m]), left, right, differs, differs_too))
            numbers = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], *(pa.array(x, pa.int32()) for x in numbers[:4]), *(pa.array(x, pa.bool_()) for x in numbers[4:6]), *(pa.array(x, pa.int64()) for x in numbers[6:])],
                names=[*given, "left", "right", "left_end", "right_end"],
            )

    return pairs.mapInArrow(extend, f"id {kind}, keep_ids array<{kind}>, with_id {kind}, apart int, start int, end int, first int, upto int, left boolean, right boolean, left_end long, right_end long")


_BLANK = b"\t\n\x0b\x0c\r "


def _begun(data: bytes) -> int:
    """How many words begin behind the first byte."""
    return len(data.split()) - (data[0] not in _BLANK)


def _common(a: bytes, b: bytes) -> int:
    """How many bytes two begin with in common."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def remove(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated passages."""
    mine, spans = fresh(docs, "spans_id", "spans")
    found = repeats(docs, words, id_col, text_col)
    by_id = found.groupBy(column(id_col).alias(mine)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans))
    joined = docs.join(by_id, column(id_col) == column(mine), "left").drop(mine)
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, at, 4 << 20):
            texts = part.column(at).to_pylist()
            for i, own in enumerate(part.column(part.num_columns - 1).to_pylist()):
                if own and texts[i]:
                    data, out, done = texts[i].encode(), [], 0
                    for s in own:
                        out.append(data[done : s["start"]])
                        done = max(done, s["end"])
                    texts[i] = b"".join([*out, data[done:]]).decode("utf-8", "ignore")
            columns = list(part.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema)
