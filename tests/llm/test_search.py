"""License scans, alignment of two tokenizers and lexical search against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleamline.llm import alignment, lexical, licenses

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


# License scans


def plain_scan(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES, share=licenses.SHARE):
    words = re.findall(licenses.WORD, (text or "").translate(LOWER))
    at, base, labels, best = [], set(), set(), 0.0
    for phrase, label in phrases.items():
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        at += found
        base |= {label} if found else set()
    for start in range(0, len(words), licenses.STEP):
        block, near = set(words[start : start + licenses.BLOCK]), defaultdict(list)
        for label, family, template in templates:
            parts = set(template.split())
            held = len(parts & block)
            if held / len(parts) >= share - 1e-9:
                near[family].append((held / len(parts), held, label))
                best = max(best, held / len(parts))
        for found in near.values():
            labels |= {label for s, h, label in found if (s, h) == max(f[:2] for f in found)}
    return (
        len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | labels)), 1.0 if at else best,
    )


def license_rows(rows):
    return sorted(map(str, rows))


def check_scan(spark, df, **how):
    got = [tuple(r) for r in licenses.scan(df, **how).collect()]
    want = [(r["doc_id"], *plain_scan(r["text"], **how)) for r in df.select("doc_id", "text").collect()]
    assert license_rows(got) == license_rows(want)
    return got


def test_scan_of_documents(spark):
    check_scan(spark, documents(spark))


def test_scan_of_odd_rows(spark, odd, none):
    check_scan(spark, odd)
    assert licenses.scan(none).collect() == []


def test_scan_finds_notices_across_blocks_and_lines(spark):
    mit = licenses.TEMPLATES[0][2]
    fill = [f"filler{i}" for i in range(70)]
    texts = [" ".join([*fill[:n], *mit.upper().split(), *fill]).replace(" ", "\n", 3) for n in range(0, 70, 3)]
    # A fifth of a template's words may differ; a sixth of its words more may not.
    words = mit.split()
    texts += [" ".join(["x" if i < k else w for i, w in enumerate(words)]) for k in range(8)]
    texts += [
        "Licensed under the GNU General Public License, version 2.", "licensed under the GNU General Public License version 3 or 2",
        "Licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "MİT Kelvin under the mit license",
    ]
    got = check_scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {i: row[-2] for i, *row in got}
    assert all(found[i] == "mit" for i in range(24))
    assert [found[len(texts) - 5 + i] for i in range(4)] == ["gpl-2", "gpl-2,gpl-3", "cc-by", "cc-by-nc"]


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_join_keeps_every_match_of_random_sets(spark, share):
    rng = np.random.default_rng(7)
    word = [f"w{i}" for i in range(24)]
    templates = [(f"t{i}", f"f{i % 3}", " ".join(rng.choice(word, rng.integers(1, 10)))) for i in range(12)]
    texts = [" ".join(word[i] for i in (rng.random(rng.integers(0, 12)) ** 2 * 24).astype(int)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_scan(spark, df, templates=templates, phrases={"w0 w1": "a"}, share=share)


# Alignment


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    letters = alignment._byte_letters()
    a_bytes = {i: bytes(map(letters.get, t)) for t, i in a.get_vocab().items() if all(c in letters for c in t)}
    counts, docs, found = Counter(), Counter(), []
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bx = [a_bytes[i] for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or any(b"".join(t) != (" " + text).encode() for t in (bx, by)):
            x, y, bx, by = [], [], [], []
        ends = [dict(zip(np.cumsum([len(t) for t in s]).tolist(), range(len(s)))) for s in (bx, by)]
        links, groups, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            to_i, to_j = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(map(str, x[i:to_i])) + "|" + ",".join(map(str, y[j:to_j])))
            links.append((x[to_i - 1], y[to_j - 1]))
            i, j = to_i, to_j
        counts.update(links)
        docs.update(set(links))
        found.append((doc, len(x), len(y), links, ";".join(groups)))
    top = defaultdict(int)
    for (_, q), n in counts.items():
        top[q] = max(top[q], n)
    out = [
        (doc, n, m, len(links), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(line.encode()).hexdigest() if line else "")
        for doc, n, m, links, line in found
    ]
    return out, {(*p, docs[p], n, n == top[p[1]]) for p, n in counts.items()}


def check_alignment(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want, pairs = plain_alignment(rows)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in alignment.align(df, FIRST, SECOND).collect())
    return pairs


def test_alignment_of_documents(spark):
    df = documents(spark)
    pairs = check_alignment(df)
    assert pairs == {tuple(r) for r in alignment.pair_counts(df, FIRST, SECOND).collect()}


def test_alignment_of_odd_rows(spark, odd, none):
    check_alignment(odd)
    assert alignment.align(none, FIRST, SECOND).collect() == []


def test_alignment_of_long_runs_and_marks(spark):
    texts = ["a" * 5000, " " * 3000 + "x", "<|endoftext|> <s> </s> <0x41>", "▁ a", "\x00\x01 \r\n\t x", "é" * 2100, "𝔘𝔫𝔦 🙂🙂"]
    check_alignment(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string"))


def test_alignment_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 16)
    check_alignment(documents(spark).limit(80))


def test_planes_hold_every_multiplicity():
    rng = np.random.default_rng(3)
    docs, pairs = 300, 40
    grid = rng.integers(0, 70, (pairs, docs)) * (rng.random((pairs, docs)) < rng.random((pairs, 1)) ** 3)
    pair, doc = np.nonzero(grid)
    planes = alignment.Planes.of(pair + 5, doc, grid[pair, doc], docs)
    assert len(planes.bits) and len(planes.places)
    planes = alignment.Planes.unpack(docs, *planes.pack())
    found, held, links = planes.counts()
    there = np.unique(pair)
    assert (found == there + 5).all() and (held == (grid > 0).sum(axis=1)[there]).all() and (links == grid.sum(axis=1)[there]).all()
    back = np.zeros_like(grid)
    entry, at = planes.postings()
    np.add.at(back, (planes.pair[entry] - 5, at), 1 << planes.digit[entry])
    assert (back == grid).all()


# Lexical search


def plain_search(docs, items, top=20):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    tf = [(d, Counter(rx.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        terms = rx.findall((text or "").translate(LOWER))
        found = []
        for d, c in tf:
            m = 75 + (25 * c.total() * n_docs) // max(1, length)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms
            )
            if score > 0:
                found.append((-score, d is None, d if d is not None else 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(map(str, out))


def check_search(docs, items, **how):
    got = sorted(str((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in lexical.search(docs, items, **how).collect())
    rows = [[tuple(r) for r in df.collect()] for df in (docs.select("doc_id", "text"), items.select("item_id", "text"))]
    assert got == plain_search(*rows, top=how.get("top", 20))


def test_search_of_documents(spark):
    check_search(documents(spark), documents(spark, "benchmark"))


def test_search_in_many_blocks_of_items(spark):
    check_search(documents(spark), documents(spark, "benchmark"), item_chars=700, top=3)


def test_search_of_odd_rows(spark, odd, none):
    items = [(1, "The QUICK quick fox"), (1, "The QUICK quick fox"), (2, None), (3, ""), (None, "word529 x été"), (4, "nowhere")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    check_search(odd, asked)
    check_search(none, asked)
    assert lexical.search(odd, asked.limit(0)).collect() == []
    text_ids = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    check_search(text_ids.filter("doc_id is not null"), asked)


def test_search_with_ties(spark):
    docs = spark.createDataFrame([(100 - i, "same words here") for i in range(60)] + [(7, "other")], "doc_id long, text string")
    check_search(docs, spark.createDataFrame([(1, "same"), (2, "words here words")], "item_id int, text string"))


def test_graph_shares_and_keeps_every_term():
    rng = np.random.default_rng(1)
    items = [[b"t%d" % t for t in (rng.random(rng.integers(0, 40)) ** 3 * 60).astype(int)] for _ in range(120)]
    graph = lexical.share(items)
    for i, terms in enumerate(items):
        assert graph.expanded(i) == sorted(Counter(terms).items())
    assert graph.additions() < 0.8 * sum(max(0, len(set(t)) - 1) for t in items)


def test_terms_in_pieces_are_those_of_the_text():
    text = "Ab9-é_x " * 300
    assert [t for p in lexical._pieces(text, 50) for t in p] == lexical.terms_of(text)
