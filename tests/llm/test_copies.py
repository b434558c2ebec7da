"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from gleamline.llm import chunks, exact_dedup, simhash
from gleamline.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(rows):
    norm = [SPACE.sub(" ", r[1] or "") for r in rows]
    out = []
    for n in norm:
        ids = [r[0] for r, m in zip(rows, norm) if m == n]
        out.append((min((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_exact_on_odd_rows(odd, odd_rows):
    got = exact_dedup.duplicates(odd, runs=8).collect()
    want = [(r[0], *b) for r, b in zip(odd_rows, brute_exact(odd_rows))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({w[3] for w in want}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_any_fan(odd):
    def rows(**how):
        return sorted(map(str, exact_dedup.duplicates(odd, **how).collect()))

    assert rows(runs=8) == rows(runs=64, fan_bits=1) == rows(runs=16, fan_bits=4)


def test_drop_duplicates_keeps_columns(odd, odd_rows, none):
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len({b[2] for b in brute_exact(odd_rows)})
    assert {1, 3, 8, 9} <= {r.doc_id for r in rows} and not {2, 4} & {r.doc_id for r in rows}
    assert exact_dedup.drop_duplicates(none).count() == exact_dedup.duplicates(none).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    """The smallest number in each one's component, by a closure over all pairs."""
    x = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_query(spark):
    got = {r.doc_id: r for r in QUERIES["op5_simhash"](spark, SF_DIR).collect()}
    rows = sorted(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text) for r in rows]
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [got[r.doc_id].component_id for r in rows] == [rows[i].doc_id for i in brute_components(fps, 2)]


def _partition(spark, fps, bits):
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    linked = simhash.links(nodes, bits)
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= bits for a, b in linked.collect())
    roots = dict(simhash.components(linked).collect())
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(roots.get(f, f), set()).add(i)
    return sorted(map(sorted, groups.values()))


def _brute(fps, bits):
    groups = {}
    for i, r in enumerate(brute_components(fps, bits)):
        groups.setdefault(r, set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_links_lose_no_connection(spark, monkeypatch):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:12]:
        for _ in range(25):  # walks, so that components are longer than a link
            for b in rng.sample(range(64), rng.choice((1, 2, 3))):
                base ^= 1 << b
            fps.add(base)
    fps = sorted(fps)
    assert _partition(spark, fps, 2) == _brute(fps, 2)
    assert _partition(spark, fps, 1) == _brute(fps, 1)
    monkeypatch.setattr(simhash, "GROUP", 4)  # groups above it are dealt out again
    dense = sorted({(1 << 40) ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 4))) for _ in range(600)})
    assert _partition(spark, dense, 2) == _brute(dense, 2)


def test_near_copies_on_odd_rows(odd, odd_rows, none):
    got = simhash.near_duplicates(odd).collect()
    fps = [brute_fingerprint(r[1]) for r in odd_rows]
    group = brute_components(fps, 2)
    want = []
    for i, r in enumerate(odd_rows):
        ids = [odd_rows[j][0] for j in range(len(odd_rows)) if group[j] == group[i] and odd_rows[j][0] is not None]
        want.append(str((r[0], min(ids, default=None))))
    assert sorted(want) == sorted(str((r.doc_id, r.component_id)) for r in got)
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {min(x[0] for x, g in zip(odd_rows, group) if g == k and x[0]) for k in set(group)}
    assert simhash.drop_near_duplicates(none).count() == 0


def test_one_row_of_each_group_stays_where_identifiers_repeat_or_lack(spark):
    rng = random.Random(3)
    a, b, c = (_words(rng, 400) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " end"
    rows = [(1, a), (1, a), (2, a), (1, near), (None, a), (None, b), (None, b), (None, b + " x"), (5, c), (4, c)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, root int")
    marks = [tuple(r) for r in simhash.near_duplicates(df).select("fp", "component_id").distinct().collect()]
    assert {m for _, m in marks} == {1, None, 4}
    kept = simhash.drop_near_duplicates(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "None"] and len({r.text[:50] for r in kept}) == 3
    many = df.limit(1).crossJoin(spark.range(500)).drop("id")
    assert simhash.drop_near_duplicates(many).count() == 1


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_repeated_passages(spark, none):
    rng = random.Random(7)
    texts = {i: _words(rng, rng.randint(60, 400)) for i in range(1, 200)}
    planted = {}
    for k in range(40):
        passage, at = _words(rng, rng.randint(52, 80)), rng.sample(range(1, 200), 3)
        if any(a in planted for a in at):
            continue
        for a in at:
            cut = rng.randint(0, len(texts[a]))
            texts[a] = texts[a][:cut] + " " + passage + " " + texts[a][cut:]
            planted[a] = min(at)
    line, short = _words(rng, 8), _words(rng, 44)
    for i in (150, 160, 170):
        texts[i] += "\n" + line
    for i in (151, 161):
        texts[i] += "\n" + short
    rows = [(i, t, 1) for i, t in texts.items()] + [(None, _words(rng, 70), 1), (300, None, 1), (301, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    found = chunks.repeats(docs).collect()
    assert {r.doc_id for r in found} == {a for a, first in planted.items() if a != first}
    for r in found:
        assert {planted.get(i) for i in r.keep_ids} == {planted[r.doc_id]}
        data = texts[r.doc_id].encode()[r.start : r.end]
        assert len(r.keep_ids) > 1 or data in texts[planted[r.doc_id]].encode()
    cleaned = chunks.remove(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert chunks.repeats(cleaned).count() == 0
    clean = {r.doc_id: r.text for r in cleaned.collect()}
    assert clean[300] is None and all(clean[i] == t for i, t in texts.items() if planted.get(i, i) == i)
    assert chunks.repeats(none).count() == 0


def test_no_passage_of_short_words_is_missed(spark):
    rng = random.Random(11)

    def short(n, most):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, most))) for _ in range(n))

    texts, want = {}, {}
    for k in range(600):
        passage = short(50 + k % 2, 1 + k % 4)
        for i in (2 * k, 2 * k + 1):
            front = short(rng.randint(0, 60), 6) + f" {i}é"
            texts[i] = f"{front}\n{passage} é{i} " + short(rng.randint(0, 60), 6)
            want[i] = (len(f"{front}\n".encode()), passage)
    lone = short(49, 4)
    texts |= {2000: f"x\n{lone}\ny", 2001: f"z {lone} w"}
    # A passage longer than any step of the comparison, with pieces of it in texts before.
    long = short(900, 9)
    texts |= {3000 + j: f"{j} " + long[700 * j : 700 * j + 200] for j in range(6)} | {3010: long, 3011: f"front\n{long}\nbehind"}
    found = {r.doc_id: r for r in chunks.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i for i in found if i < 3000} == {i for i in want if i % 2}
    for i in (i for i in want if i % 2):
        start, passage = want[i]
        r, own = found[i], texts[i].encode()
        assert r.start <= start and r.end >= start + len(passage) and r.n_words >= len(passage.split()) and r.keep_ids == [i - 1]
        assert own[r.start : r.end] in texts[i - 1].encode()
    assert texts[3011].encode()[found[3011].start : found[3011].end].strip() == long.encode() and found[3011].n_words == 900


def brute_windows(texts, words):
    """Per text the whole words that windows of ``words`` whole words repeat from an earlier place, as bytes."""
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        spans = [m.span() for m in re.finditer(rb"[^ \t-\r]+", data)]
        for lo, hi in ((spans[j][0], spans[j + words - 1][1]) for j in range(len(spans) - words + 1)):
            if data[lo:hi] in seen:
                out.setdefault(i, []).append((lo, hi))
            seen.add(data[lo:hi])
    return out


def _lost(found, want):
    """Windows that no reported passage of their text holds."""
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    return [(i, w) for i, ws in want.items() for w in ws if not any(a <= w[0] and w[1] <= b for a, b in spans.get(i, []))]


def test_no_passage_is_missed_whose_parts_stand_in_other_texts(spark):
    rng = random.Random(23)
    texts, want = {}, set()
    for k in range(40):
        passage, at = _words(rng, 70).split(), 10 * k
        noise = [_words(rng, 20 + rng.randint(0, 30)) for _ in range(8)]
        parts = [passage[:45], passage[25:], passage, passage]
        if k % 4 == 1:  # a part stands twice in the later text, before the passage
            parts[3] = passage[:45] + _words(rng, 9).split() + passage
        if k % 4 == 2:  # and in the one that holds the passage first
            parts[2] = passage[20:60] + _words(rng, 9).split() + passage
        if k % 4 == 3:  # the text with the parts holds a longer common part with the first copy
            parts[0] = noise[4].split()[-30:] + passage[:45]
        for j, part in enumerate(parts):
            texts[at + j] = f"{noise[2 * j % 8]} {' '.join(part)} {noise[(2 * j + 1) % 8]}"
        want.add(at + 3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found, brute = chunks.repeats(docs).collect(), brute_windows(texts, 50)
    assert want <= set(brute) and {r.doc_id for r in found} == set(brute)
    assert not _lost(found, brute)
    assert all(i < r.doc_id or i == r.doc_id for r in found for i in r.keep_ids)


def test_no_window_of_the_documents_is_missed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    brute = brute_windows({r.doc_id: r.text or "" for r in docs.collect()}, 50)
    found = chunks.repeats(docs).collect()
    assert brute and not _lost(found, brute)


def test_chunks_resist_shifts():
    rng = random.Random(9)
    text = _words(rng, 2000) + " éè \U0001f642" * 50
    data = text.encode()
    ends = chunks.boundaries(np.frombuffer(data, np.uint8)).tolist()
    assert ends[-1] == len(data) and max(np.diff([0, *ends])) <= chunks.REACH
    assert "".join(data[a:b].decode() for a, b in zip([0, *ends], ends)) == text
    moved = chunks.boundaries(np.frombuffer(b"inserted " + data, np.uint8)).tolist()
    assert set(e + 9 for e in ends[4:]) == set(e for e in moved if e >= ends[4] + 9)


def test_repeated_passages_on_odd_rows(odd):
    found = chunks.repeats(odd).collect()
    assert {(r.doc_id, tuple(r.keep_ids)) for r in found} == {(9, (8,))} or {r.doc_id for r in found} == {8, 9}


def test_seeds_of_a_batch_are_those_of_each_text():
    rng = random.Random(11)
    parts = [*"ab é\U0001f642\n\t ", "word", "  ", "中文"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 20, 60, 400]))).encode() for _ in range(200)]
    texts += [b"x" * (chunks.SEED + chunks.SPAN - 2), b"x" * (chunks.SEED + chunks.SPAN - 1)]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    row, begins, ends = chunks.seeds_of(raw, edges)
    assert (np.diff(row) >= 0).all() and row[-1] == len(texts) - 1 and len(texts) - 2 not in row
    for i, t in enumerate(texts):
        mine = row == i
        assert (np.unique(want := chunks.boundaries(np.frombuffer(t, np.uint8))) == want).all()
        want = [e for e in want.tolist() if e >= chunks.SEED] if len(t) >= chunks.SEED + chunks.SPAN - 1 else []
        assert (ends[mine] - edges[i]).tolist() == want
        for a, b in zip(begins[mine].tolist(), ends[mine].tolist()):
            assert edges[i] <= a and chunks.SEED - 3 <= b - a <= chunks.SEED and raw[a:b].tobytes().decode()
