"""Near-duplicates by SimHash, with pigeonring filtering.

A fingerprint's 64 bits lie on a ring of ``SEGMENTS`` segments.  If two fingerprints differ in at most
``bits`` bits, then there is a segment from which on every chain of ``l`` consecutive segments differs
in at most ``l * bits / SEGMENTS`` bits.  Candidates are found by the segments at a chain's start
that this budget leaves equal; a pair is a candidate only if the whole chain keeps its budgets, and
is linked after the full Hamming check.

Candidates are looked for between different fingerprints only.  Those that share a key are read in
sorted order by a task that links each to one already reached, so a group of ``n`` gives fewer than ``n``
links and not all its pairs, without losing a connection.  A group above ``GROUP`` is dealt
out again by keys of more bits, one of three of which two near fingerprints must share, until the
bits left bound its size.

Components are found with alternating large and small stars; every step is an aggregate and a join.

Defined cases: a null text has no words; texts without words have fingerprint zero and are near each
other.  Rows that repeat are near each other; ``component_id`` is the smallest identifier that isn't
null, and null where there is none.  ``drop_near_duplicates`` keeps one row of a component, rows that
repeat or lack an identifier included.  An empty table gives no rows; other columns are passed on by
``drop_near_duplicates`` and otherwise ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleamline.llm.common import bounded, by_run, column, fresh, run_count, run_of
from gleamline.session import stage

SEGMENTS = 6
GROUP = 4096
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash over the word shingles of a text; see the module for texts of few words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) > shingle:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    else:
        parts, n = iter([b" ".join(words)]), 1
    digest, seed, ones = xxhash.xxh64_intdigest, SEED, np.zeros(64, np.int64)
    left = n
    while left:
        # In blocks, so that a long text takes no more memory than a short one.
        m = min(left, 16_384)
        h = np.fromiter((digest(p, seed) for _, p in zip(range(m), parts)), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= m
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, shingle: int = 3, text_col: str = "text") -> DataFrame:
    """``rows`` with ``fp``, the fingerprint as a signed 64-bit number, in the place of the text."""
    others = [c for c in rows.columns if c != text_col]
    rows = rows.select(column(text_col).cast("string"), *map(column, others))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 0, 4 << 20):
            fps = np.array([fingerprint(t, shingle) for t in part.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(fps)], names=[*others, "fp"])

    kept = rows.select(*map(column, others)).schema
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _ring(bits: int) -> tuple[list[int], list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """Segments' masks; for each ring start the (mask, budget) of its chains; the keys' (mask, start)."""
    width, extra = divmod(64, SEGMENTS)
    segment, at = [], 0
    for i in range(SEGMENTS):
        n = width + (i < extra)
        segment.append(((1 << n) - 1) << at)
        at += n

    def chain(i: int, length: int) -> int:
        mask = 0
        for j in range(length):
            mask |= segment[(i + j) % SEGMENTS]
        return mask

    chains = [[(chain(i, n), n * bits // SEGMENTS) for n in range(1, SEGMENTS + 1)] for i in range(SEGMENTS)]
    keys = []
    for i in range(SEGMENTS):
        equal = max([n for n in range(1, SEGMENTS + 1) if n * bits // SEGMENTS == 0], default=0)
        one = [n for n in range(1, SEGMENTS + 1) if n * bits // SEGMENTS == 1]
        if not one:
            keys.append((chain(i, equal), i))
            continue
        # Of the segments that may differ in one bit together, the first is equal or the others are.
        head, first = chain(i, equal), segment[(i + equal) % SEGMENTS]
        rest = chain(i, max(one)) & ~head & ~first
        keys += [(head | first, i), (head | rest, i)] if rest else [(head, i)]
    return segment, chains, [(m, i) for m, i in keys if m]


def _refined(mask: int, bits: int) -> list[int]:
    """Masks of more bits, one of which two fingerprints equal under ``mask`` must share."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [free[k * len(free) // (bits + 1) : (k + 1) * len(free) // (bits + 1)] for k in range(bits + 1)]
    return [mask | sum(1 << b for b in p) for p in parts]


def _connect(fps: np.ndarray, near) -> Iterator[tuple[int, int]]:
    """Links that connect what ``near`` connects, fewer than there are fingerprints."""
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            hit = near(at ^ rest)
            if hit.any():
                reached = rest[hit]
                rest = rest[~hit]
                yield from ((int(at), int(r)) for r in reached)
                frontier.extend(reached)


def links(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links between the different fingerprints ``fp`` of ``nodes`` that connect all within ``bits`` bits."""
    _, chains, keys = _ring(bits)
    if not keys:
        raise ValueError(f"more than {bits} bits need more segments")
    nodes, out = stage(nodes.select("fp")), None
    table = [(mask, start) for mask, start in keys]
    frame = nodes.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, (m, _) in enumerate(table)])).alias("k")
    ).select("fp", "k.kind", "k.key")
    while True:
        found = stage(_within_groups(frame, table, chains, bits))
        linked = found.filter("kind IS NULL").select("a", "b")
        out = linked if out is None else out.unionByName(linked)
        over = found.filter("kind IS NOT NULL")
        # One row per kind: whether any group was too large, and with which masks to go on.
        kinds = sorted(r["kind"] for r in over.select("kind").distinct().collect())
        if not kinds:
            return out.distinct()
        children, child_of = [], {}
        for k in kinds:
            mask, start = table[k]
            child_of[k] = [(len(children) + j, m) for j, m in enumerate(_refined(mask, bits))]
            children += [(m, start) for m in _refined(mask, bits)]
        cases = F.lit(None)
        for k in kinds:
            parts = F.array(*[F.struct(F.lit(c).alias("kind"), F.col("a").bitwiseAND(F.lit(_signed(m))).alias("key")) for c, m in child_of[k]])
            cases = F.when(F.col("kind") == k, parts).otherwise(cases)
        frame = over.select(F.col("a").alias("fp"), F.explode(cases).alias("k")).select("fp", "k.kind", "k.key").distinct()
        table = children


def _within_groups(frame: DataFrame, table: list[tuple[int, int]], chains, bits: int) -> DataFrame:
    """(a, b, kind): links within each (kind, key), kind null; or fingerprints of too large a group."""
    # The bits outside the mask bound a group: small enough ones are never dealt out again.
    limit = [1 << 64 if 64 - m.bit_count() <= 12 else GROUP for m, _ in table]

    def near(start: int):
        tests = [(np.uint64(m), b) for m, b in chains[start]]

        def test(x: np.ndarray) -> np.ndarray:
            ok = np.bitwise_count(x) <= bits
            for mask, budget in tests[:-1]:
                ok &= np.bitwise_count(x & mask) <= budget
            return ok

        return test

    tests = [near(s) for s in range(SEGMENTS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        spilling: tuple[int, int] | None = None

        def result(a: list, b: list, kind: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)),
                    pa.array(kind, pa.int32()),
                ],
                names=["a", "b", "kind"],
            )

        def groups(fp, kind, key, last: bool):
            nonlocal carry, spilling
            a, b, k = [], [], []
            edge = np.flatnonzero((np.diff(kind) != 0) | (np.diff(key) != 0)) + 1
            begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
            if not last:
                # The last group may go on; once too large, it is passed on as it comes.
                at = int(begin[-1])
                begin, end = begin[:-1], end[:-1]
                rest = fp[at:], kind[at:], key[at:]
            else:
                rest = tuple(x[len(fp) :] for x in (fp, kind, key))
            if spilling is not None and len(begin) and (int(kind[0]), int(key[0])) == spilling:
                a += fp[: end[0]].tolist()
                b += fp[: end[0]].tolist()
                k += kind[: end[0]].tolist()
                begin, end, spilling = begin[1:], end[1:], None
            size = end - begin
            two = begin[size == 2]
            for s in range(SEGMENTS):
                own = two[np.isin(kind[two], [i for i, (_, start) in enumerate(table) if start == s])]
                own = own[tests[s](fp[own] ^ fp[own + 1])]
                a += fp[own].tolist()
                b += fp[own + 1].tolist()
                k += [None] * len(own)
            for i in np.flatnonzero(size > 2).tolist():
                lo, hi, what = int(begin[i]), int(end[i]), int(kind[begin[i]])
                if hi - lo > limit[what]:
                    a += fp[lo:hi].tolist()
                    b += fp[lo:hi].tolist()
                    k += [what] * (hi - lo)
                    continue
                for x, y in _connect(fp[lo:hi], tests[table[what][1]]):
                    a.append(x)
                    b.append(y)
                    k.append(None)
            if len(rest[0]):
                what = int(rest[1][0]), int(rest[2][0])
                if what == spilling or len(rest[0]) > limit[what[0]]:
                    a += rest[0].tolist()
                    b += rest[0].tolist()
                    k += rest[1].tolist()
                    spilling, rest = what, tuple(x[:0] for x in rest)
                elif spilling != what:
                    spilling = None
            carry = rest
            return result(a, b, k)

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.asarray(batch.column(0)).view(np.uint64)
            kind, key = np.asarray(batch.column(1)).astype(np.int64), np.asarray(batch.column(2))
            yield groups(*(np.concatenate(x) for x in zip(carry, (fp, kind, key))), last=False)
        if len(carry[0]):
            yield groups(*carry, last=True)

    dealt = frame.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp")
    return dealt.mapInArrow(run, "a long, b long, kind int")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the root is the same within a component."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    ordered = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo")
    e = stage(ordered.distinct())
    before = state(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stage(large)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = stage(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct())
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _marks(docs: DataFrame, shingle: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, fp, component_id, root), one row per row of ``docs``; a root names a component, with or without identifiers."""
    runs = run_count(docs.sparkSession)
    given = docs.select(
        column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("text_key"), column(text_col).alias("text")
    )
    rows = stage(fingerprints(given, shingle).withColumn("run", run_of(F.col("id"), runs)))
    node = by_run(rows, ["fp"], [F.min("id").alias("id")], [F.min("id").alias("first_id")])
    nodes = stage(node)
    whole = nodes.groupBy("fp").agg(F.first("first_id").alias("first_id"))
    roots = components(links(whole, bits))
    rooted = stage(
        whole.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        )
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = rooted.join(least, "root").select("fp", "component_id", "root")
    by_fp_run = nodes.select("run", "fp").join(component, "fp")
    return rows.join(by_fp_run, ["run", "fp"]).select("id", "text_key", "fp", "component_id", "root")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text_key, fp, component_id), one row per row of ``docs``; ``text_key`` is a hash of the text."""
    marks = _marks(docs, shingle, bits, id_col, text_col)
    return marks.select(F.col("id").alias(id_col), "text_key", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of every component of ``docs``: one with the smallest identifier, or without one where none has any.

    Of several such rows one with the smallest hash of its text stays, and of those with equal texts any one.
    """
    marks = stage(_marks(docs, shingle, bits, id_col, text_col).select("id", "text_key", "component_id", "root"))
    mine, key = fresh(docs, "drop_id", "drop_text")
    same = column(id_col).eqNullSafe(F.col(mine)) & (F.xxhash64(column(text_col)) == F.col(key))

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias(mine), F.col("text_key").alias(key))

    foremost = F.col("id").eqNullSafe(F.col("component_id"))
    drop, least = named(marks.filter(~foremost)), marks.filter(foremost)
    # Only where rows repeat an identifier, or have none, has a component more than one.
    several = stage(least.groupBy("root").agg(F.min("text_key").alias("stays"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    if several.isEmpty():
        return docs.join(drop, same, "left_anti")
    least = least.join(several, "root")
    others = named(least.filter("text_key != stays").select("id", "text_key").distinct())
    repeated = named(least.filter("text_key = stays").groupBy("id", "text_key").count().filter("count > 1"))
    kept = docs.join(drop.unionByName(others), same, "left_anti")
    once = kept.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, same, "left_anti").unionByName(once)


def hexadecimal(fp: str) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
