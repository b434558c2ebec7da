"""Secret scans with one deterministic automaton for all rules.

The rules' expressions are compiled (``automaton``) by subset construction and minimisation into one
transition array.  Documents are cut at bytes that lead every state back to the start, such as line
breaks; all parts of a batch then take their steps together, one array lookup per byte position, so each
byte is read once for all rules.  The few parts in which a rule ends are read again, rule by rule,
for the matches' exact places: from the left, without overlaps, as long as possible.

Spans are (kind, start, end) in code points, the end exclusive.  A rule may ask for a least length of
its match or of what stands after its head; shorter matches are dropped after they were found.  A
private key's match goes on over its body to its last line, or where that is missing over all that may be
key; a word that follows directly may then count as its last piece.

Defined cases: a null text counts as empty.  Texts of any length are read whole.  Rows that repeat and
null identifiers are passed on as they are; an empty table gives no rows; other columns are passed on by
``redact`` and otherwise ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleamline.llm.automaton import Automaton, compile_rules
from gleamline.llm.common import bounded, column, fresh


@dataclass(frozen=True)
class Rule:
    kind: str
    #: What a match is.
    pattern: str
    #: Least length in bytes of the match behind ``head``, or of the whole match without one.
    least: int = 0
    #: What stands before the secret itself.
    head: str = ""
    #: What follows and belongs to the secret, line breaks included; ``pattern`` alone tells the rule.
    body: str = ""


_WORD = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"

# The base rules.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 12, _WORD + r"""["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
# What follows a private key's first line: anything up to its last line, if no other such line comes before;
# without a last line header fields and base64, one short piece included, as a key's last line may be short.
_BASE64 = r"[A-Za-z0-9+/=]"
_BREAK = r"""[\x20\t>"'|#*]*[\r\n][\x20\t\r\n>"'|#*]*"""
_GAP = r"""[\x20\t\r\n>"'|#*,;`\\]+"""
_TO_END = r"(-{0,4}[^-])*-----END[A-Z\x20]*PRIVATE\x20KEY-{0,5}"
_NO_END = rf"({_GAP}[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n\\]*)*({_BREAK}{_BASE64}+|{_GAP}{_BASE64}{{16,}})*({_GAP}{_BASE64}{{16,}}{_GAP}{_BASE64}+)?"

# Public forms of other keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("private", r"-----BEGIN[A-Z\x20]*PRIVATE\x20KEY-----", body=f"({_TO_END}|{_NO_END})"),
)
RULES = BASE + MORE


class Scanner:
    """All rules' automaton, and one for each rule's matches and heads."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        # A rule is told by any match of it; one that is a mere run of a class by a long enough run.
        told = [
            f"{r.pattern[:-1]}{{{r.least},}}" if r.least and re.fullmatch(r"\[[^]]*\]\+", r.head + r.pattern) else r.head + r.pattern
            for r in rules
        ]
        self.all: Automaton = compile_rules(told, anywhere=True)
        self.each = [compile_rules([r.head + r.pattern + r.body]) for r in rules]
        self.heads = [compile_rules([r.head]) if r.head else None for r in rules]
        # Bytes that lead from every state to the start.
        self.reset = (self.all.next == self.all.start).all(axis=0)

    def hits(self, joined: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Numbers of the documents of ``joined``, cut at ``edges``, in which some rule ends."""
        if not len(joined):
            return np.zeros(0, np.int64)
        cut = self.reset[joined]
        cut[edges[1:][edges[1:] > 0] - 1] = True
        end = np.flatnonzero(cut) + 1
        begin = np.concatenate([[0], end[:-1]])
        size = end - begin
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        flat, accept = self.all.flat, self.all.accept != 0
        state = np.full(len(begin), self.all.start, self.all.flat.dtype)
        hit = np.zeros(len(begin), bool)
        # How many parts are longer than each step.
        longer = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) + 1), "right")
        for step in range(int(size[0])):
            n = int(longer[step])
            state[:n] = flat[state[:n].astype(np.intp) * 256 + joined[begin[:n] + step]]
            hit[:n] |= accept[state[:n]]
        at = begin[hit]
        return np.unique(np.searchsorted(edges, at, "right") - 1)

    def spans(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(start, rule, end, secret's start) of a document's matches in bytes, by start and rule."""
        out = []
        for i, (rule, dfa) in enumerate(zip(self.rules, self.each)):
            at = 0
            while True:
                found = dfa.search(data, at)
                if found is None:
                    break
                start, at = found
                secret = start
                if rule.head:
                    # The head ends where the rest is a match of the pattern: at the longest head that leaves one.
                    secret = self.heads[i].longest(data, start, at - 1)
                if at - secret >= rule.least:
                    out.append((start, i, at, secret))
        return sorted(out)


def scan(batches: Iterable[pa.RecordBatch], scanner: Scanner, text: int) -> Iterator[tuple[pa.RecordBatch, dict[int, list]]]:
    """Short batches and, by row, the spans (start, rule, end, secret's start) in code points of rows that have any."""
    for part in bounded(batches, text, 4 << 20):
        texts = [(t or "").encode() for t in part.column(text).to_pylist()]
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = {}
        for i in scanner.hits(np.frombuffer(b"".join(texts), np.uint8), edges).tolist():
            spans = scanner.spans(texts[i])
            if spans:
                found[i] = _in_points(texts[i], spans)
        yield part, found


def _in_points(data: bytes, spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    if data.isascii():
        return spans
    wanted = sorted({x for s, _, e, v in spans for x in (s, e, v)})
    point, at, count = {}, 0, 0
    for x in wanted:
        count += len(data[at:x].decode())
        point[x] = count
        at = x
    return [(point[s], r, point[e], point[v]) for s, r, e, v in spans]


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans, of every document."""
    scanner = Scanner(rules)
    base = [r.kind for r in BASE]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for part, found in scan(batches, scanner, 1):
            n = part.num_rows
            counts, digest, spans = [[0] * n for _ in base], [nothing] * n, [""] * n
            for i, hits in found.items():
                own = [(scanner.rules[r].kind, f"{scanner.rules[r].kind}:{s}:{e}") for s, r, e, _ in hits]
                for c, kind in zip(counts, base):
                    c[i] = sum(k == kind for k, _ in own)
                digest[i] = hashlib.sha256(",".join(x for k, x in own if k in base).encode()).hexdigest()
                spans[i] = ",".join(x for _, x in own)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(spans)],
                names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"],
            )

    rows = docs.select(column("doc_id"), column("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"n_{k} long" for k in base)
    return rows.mapInArrow(run, f"doc_id {kind}, {columns}, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``mark`` in the place of every secret, and ``n_chars``, if there, counted anew."""
    scanner = Scanner(rules)
    names = docs.columns
    given = docs.withColumn("text", column("text").cast("string"))
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in scan(batches, scanner, at):
            if found:
                texts = part.column(at).to_pylist()
                for i, hits in found.items():
                    texts[i] = masked(texts[i], [(v, e) for _, _, e, v in hits], mark)
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
            yield part

    out = given.mapInArrow(run, given.schema)
    if "n_chars" in names:
        (changed,) = fresh(docs, "chars")
        out = out.withColumn(changed, F.char_length(column("text")).cast(docs.schema["n_chars"].dataType))
        kept = [F.coalesce(column(changed), column("n_chars")).alias("n_chars") if c == "n_chars" else column(c) for c in names]
        out = out.select(*kept)
    return out


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with ``mark`` for each stretch that spans cover, overlapping ones together."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
