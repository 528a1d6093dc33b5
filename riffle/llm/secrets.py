"""Secret scan: fixed patterns, and sliding-window Shannon entropy of candidate strings.

A candidate is a run of at least WINDOW token characters. A window of WINDOW characters
slides over it; the counts of its characters, of each class (digits, lower case, upper
case, other), and the sum of c*log2(c) are updated by the character that enters and the
one that leaves, so a candidate costs time in proportion to its length. Windows above
their class's threshold join into spans; an allow-list of well-known harmless strings
suppresses spans. The patterns' spans are always kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

WINDOW = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits a character at least, for windows of hexadecimal digits and for all others.
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: Harmless strings: a span that holds one is suppressed.
ALLOW = (r"(?i)example", r"(?i)placeholder", r"(?i)changeme", r"x{6}", r"X{6}", r"0123456789", r"(?i)abcdefghij")
_XLOGX = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _char_class(ch: str) -> int:
    return 0 if "0" <= ch <= "9" else 1 if "a" <= ch <= "z" else 2 if "A" <= ch <= "Z" else 3


def hot_windows(s: str) -> list[tuple[int, int]]:
    """Joined windows of s that look random for their character class."""
    count: dict[str, int] = {}
    classes = [0, 0, 0, 0]
    not_hex, total, out = 0, 0.0, []
    for i, ch in enumerate(s):
        c = count.get(ch, 0)
        total += _XLOGX[c + 1] - _XLOGX[c]
        count[ch] = c + 1
        classes[_char_class(ch)] += 1
        not_hex += ch not in "0123456789abcdefABCDEF"
        if i >= WINDOW:
            old = s[i - WINDOW]
            c = count[old]
            total -= _XLOGX[c] - _XLOGX[c - 1]
            count[old] = c - 1
            classes[_char_class(old)] -= 1
            not_hex -= old not in "0123456789abcdefABCDEF"
        if i < WINDOW - 1:
            continue
        bits = math.log2(WINDOW) - total / WINDOW
        digits, lower, upper, _ = classes
        if not_hex == 0:
            hot = bits >= HEX_BITS and digits >= 3 and lower + upper >= 3
        else:
            hot = bits >= MIXED_BITS and (digits >= 3 and lower + upper >= 3 or digits >= 1 and lower >= 3 and upper >= 3)
        if hot:
            a = i - WINDOW + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def _between(a: int, b: int, cuts: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a .. b outside the cuts."""
    for x, y in sorted(cuts):
        if x > a:
            yield a, min(x, b)
        a = max(a, y)
        if a >= b:
            return
    yield a, b


def _merged(spans: Sequence[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Disjoint parts that the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for _, x, y in sorted(spans, key=lambda s: s[1]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def entropy_spans(text: str, taken: Sequence[tuple[str, int, int]], allow: Sequence[re.Pattern]) -> list[tuple[str, int, int]]:
    """Spans that the windows add, beside the spans taken. An allowed string suppresses the
    span it lies in; of a span with equals signs, only the side of the sign it lies on.
    Candidates and taken spans are both in order and walked together."""
    out, fixed, at = [], _merged(taken), 0
    for m in _CANDIDATE.finditer(text):
        while at < len(fixed) and fixed[at][1] <= m.start():
            at += 1
        to = at
        while to < len(fixed) and fixed[to][0] < m.end():
            to += 1
        for a, b in _between(*m.span(), fixed[at:to]):
            for x, y in _hot(text, a, b):
                if not any(p.search(text, x, y) for p in allow):
                    out.append(("entropy", x, y))
                elif "=" in text[x:y]:
                    signs = [(i, i + 1) for i in range(x, y) if text[i] == "="]
                    sides = [_hot(text, *side) for side in _between(x, y, signs) if not any(p.search(text, *side) for p in allow)]
                    out += [("entropy", *span) for side in sides for span in side]
        at = max(at, to - 1)
    return out


def _hot(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """hot_windows of text[a:b], in the text's positions. A window without a digit is never hot."""
    s = text[a:b]
    if len(s) < WINDOW or not any("0" <= ch <= "9" for ch in s):
        return []
    return [(a + x, a + y) for x, y in hot_windows(s)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<kind: string, start: bigint, end: bigint>>"


def _scan(text: str | None, allow: Sequence[re.Pattern]) -> tuple[list, list]:
    text = text or ""
    base = base_spans(text)
    return base, entropy_spans(text, base, allow)


def find_secrets(docs: DataFrame, allow: Sequence[str] = ALLOW) -> DataFrame:
    """(doc_id, base, added): spans of the patterns and those that the entropy adds, in
    code points, end exclusive. Null and empty texts have none; each row is scanned
    whole and by itself, so repeated rows repeat their result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(p) for p in allow]
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for b in batches:
            both = [_scan(t.as_py(), patterns) for t in b.column(1)]
            cols = [pa.array([as_rows(x[i]) for x in both], _SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {_SPANS_SQL}, added {_SPANS_SQL}")


def redact_text(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """text with each span, or union of overlapping spans, replaced by [SECRET]."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, allow: Sequence[str] = ALLOW) -> DataFrame:
    """docs, all rows and columns, with the secrets in text replaced and n_chars, where
    there is such a column, counted anew for the rows changed. Null texts stay null."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(p) for p in allow]
        for b in batches:
            texts, changed = b.column("text").to_pylist(), {}
            for i, t in enumerate(texts):
                base, added = _scan(t, patterns)
                if base or added:
                    changed[i] = redact_text(t, base + added)
            if changed:
                new = pa.array([changed.get(i, t) for i, t in enumerate(texts)], b.schema.field("text").type)
                b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), new)
                if (k := b.schema.get_field_index("n_chars")) >= 0:
                    old = b.column(k).to_pylist()
                    b = b.set_column(k, b.schema.field(k), pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(old)], b.schema.field(k).type))
            yield b

    return docs.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
