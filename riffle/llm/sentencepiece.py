"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text is escaped (space to the marker U+2581, one marker in front) and split before each
run of markers; where no piece has a marker after another character (checked when the
model is loaded), no piece crosses such a border, so the best path of a text is that of
its chunks one after another. Distinct chunks are solved together, position by position,
with numpy; long chunks one by one. A character without a piece of its own costs the
unknown penalty and is written as byte pieces.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: What an unknown character costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Chunks of more bytes than this are solved one by one.
LONG = 64
#: Distinct chunks that a task keeps before it starts anew; characters it takes at once.
KEEP, SLICE = 150_000, 1_000_000


class DoubleArray:
    """Byte trie in two arrays: the child of node by byte c is t = base[node] + c + 1 if check[t] == node."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = v
        size = 2 * len(children) + 1200
        base, check, val = [0] * size, [-1] * size, [-1] * size
        slot = {0: 0}
        check[0], free, crowded = -2, 1, 0
        for node, kids in enumerate(children):  # parents come before their children
            at = slot.pop(node)
            val[at] = value[node]
            if not kids:
                continue
            codes = sorted(kids)
            while check[free] != -1:
                free += 1
            # A base below 0 is fine: a byte that leads outside wraps to a slot whose check differs.
            b = free - codes[0] - 1
            if len(codes) > 1:
                b = max(b, crowded)
            tried = b
            while any(check[b + c + 1] != -1 for c in codes):
                b += 1
                if b - tried > 64:  # full here: nodes with several children look further on from now
                    crowded = b
            if max(b, free) + 600 > len(check):
                base += [0] * size
                check += [-1] * size
                val += [-1] * size
            base[at] = b
            for c in codes:
                check[b + c + 1] = at
                slot[kids[c]] = b + c + 1
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, val))


@dataclass
class Pieces:
    """A model's pieces, ready for encoding and decoding."""

    trie: DoubleArray
    score: np.ndarray  # natural log score of each piece
    unknown: float
    byte_id: np.ndarray  # piece of each byte, or -1
    raw: list[bytes]  # what each piece decodes to
    unk_id: int
    by_chunk: bool


def load(path: str, zipf: bool = True) -> Pieces:
    """Read a model file. Scores are the model's own; zipf: a BPE model's scores are merge
    ranks, and become log probabilities by Zipf's law, -ln(rank + 1) - ln(H_n)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    score = np.array([sp.get_score(i) for i in range(n)], np.float64)
    if zipf:
        whole = math.log(sum(1 / k for k in range(1, len(normal) + 1)))
        for k, i in enumerate(sorted(normal, key=lambda i: (-score[i], i))):
            score[i] = -math.log(k + 1) - whole
    byte_id = np.full(256, -1, np.int32)
    raw = []
    for i in range(n):
        if sp.is_byte(i):
            byte_id[int(names[i][3:5], 16)] = i
            raw.append(bytes([int(names[i][3:5], 16)]))
        elif sp.is_control(i):
            raw.append(b"")
        else:
            raw.append((names[i].replace(MARK, " ") if not sp.is_unknown(i) else " ⁇ ").encode())
    return Pieces(
        DoubleArray({names[i].encode(): i for i in normal}), score, float(score[normal].min()) - UNKNOWN_PENALTY,
        byte_id, raw, sp.unk_id(), all(re.fullmatch(f"{MARK}*[^{MARK}]*", names[i]) for i in normal),
    )


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _char_len(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def viterbi_one(p: Pieces, s: bytes) -> tuple[list[int], float]:
    """Ids and log score of the best path; of paths with equal scores, that whose last piece is longest."""
    n = len(s)
    best, back = [-math.inf] * (n + 1), [(0, 0)] * (n + 1)
    best[0] = 0.0
    base, check, value, score = p.trie.base, p.trie.check, p.trie.value, p.score
    for i in range(n):
        if best[i] == -math.inf:
            continue
        width = 1 if s[i] < 0x80 else 2 if s[i] < 0xE0 else 3 if s[i] < 0xF0 else 4
        node, single = 0, False
        for j in range(i, n):
            nxt = int(base[node]) + s[j] + 1
            if check[nxt] != node:
                break
            node = nxt
            v = int(value[node])
            if v >= 0:
                single |= j + 1 - i == width
                if best[i] + score[v] > best[j + 1]:
                    best[j + 1], back[j + 1] = float(best[i] + score[v]), (i, v)
        if not single and best[i] + p.unknown > best[i + width]:
            best[i + width], back[i + width] = best[i] + p.unknown, (i, -1)
    ids, at = [], n
    while at:
        i, v = back[at]
        ids += [v] if v >= 0 else [int(p.byte_id[c]) for c in reversed(s[i:at])] if p.byte_id[0] >= 0 else [p.unk_id]
        at = i
    return ids[::-1], best[n]


def _viterbi_many(p: Pieces, chunks: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The same for many chunks of at most LONG bytes, all at once by position."""
    n, length = len(chunks), np.array([len(c) for c in chunks])
    top = int(length.max())
    text = np.frombuffer(b"".join(c.ljust(top, b"\0") for c in chunks), np.uint8).reshape(n, top)
    best = np.full((n, top + 5), -np.inf)
    best[:, 0] = 0.0
    piece, step = np.full((n, top + 5), -1, np.int32), np.zeros((n, top + 5), np.int8)
    base, check, value, score = p.trie.base, p.trie.check, p.trie.value, p.score
    for i in range(top):
        rows = np.flatnonzero((length > i) & (best[:, i] > -np.inf))
        if not len(rows):
            continue
        here, width = best[rows, i], _char_len(text[rows, i])
        node, single, live = np.zeros(len(rows), np.int32), np.zeros(len(rows), bool), np.arange(len(rows))
        for j in range(i, top):
            live = live[length[rows[live]] > j]
            nxt = base[node[live]] + text[rows[live], j] + 1
            ok = check[nxt] == node[live]
            live, nxt = live[ok], nxt[ok]
            if not len(live):
                break
            node[live] = nxt
            v = value[nxt]
            hit = live[v >= 0]
            v = v[v >= 0]
            single[hit] |= width[hit] == j + 1 - i
            new = here[hit] + score[v]
            win = new > best[rows[hit], j + 1]
            r = rows[hit[win]]
            best[r, j + 1], piece[r, j + 1], step[r, j + 1] = new[win], v[win], j + 1 - i
        for w in (1, 2, 3, 4):
            lone = np.flatnonzero(~single & (width == w))
            r, new = rows[lone], here[lone] + p.unknown
            win = new > best[r, i + w]
            r = r[win]
            best[r, i + w], piece[r, i + w], step[r, i + w] = new[win], -1, w
    out, used, at, rows = np.zeros((n, top), np.int32), np.zeros(n, np.int64), length.copy(), np.arange(n)
    while len(rows := rows[at[rows] > 0]):
        v, w = piece[rows, at[rows]], step[rows, at[rows]]
        known = rows[v >= 0]
        out[known, used[known]] = v[v >= 0]
        used[known] += 1
        for k in range(4 if p.byte_id[0] >= 0 else 1):
            r = rows[(v < 0) & (w > k)]
            out[r, used[r]] = p.byte_id[text[r, at[r] - 1 - k]] if p.byte_id[0] >= 0 else p.unk_id
            used[r] += 1
        at[rows] -= w
    return [out[i, : used[i]][::-1] for i in range(n)], best[np.arange(n), length]


class Encoder:
    """Encodes texts, keeping the chunks that it has solved."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[str, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.flat, self.start, self.count, self.cost = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _solve(self) -> None:
        new = [(MARK + c).encode() for c in islice(self.seen, len(self.start), None)]
        if not new:
            return
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(new)
        cost = np.zeros(len(new))
        by_size = defaultdict(list)
        for k, c in enumerate(new):
            by_size[min(len(c) - 1, LONG) // 8].append(k)
        for size, ks in by_size.items():
            if size == LONG // 8:
                for k in ks:
                    got, cost[k] = viterbi_one(self.p, new[k])
                    ids[k] = np.array(got, np.int32)
                continue
            for i in range(0, len(ks), 50_000):
                part = ks[i : i + 50_000]
                got, c = _viterbi_many(self.p, [new[k] for k in part])
                cost[part] = c
                for k, x in zip(part, got):
                    ids[k] = x
        count = np.array([len(x) for x in ids])
        old = len(self.flat)
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32) if old else np.concatenate(ids)
        self.start = np.concatenate([self.start, old + np.cumsum(count) - count])
        self.count, self.cost = np.concatenate([self.count, count]), np.concatenate([self.cost, cost])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, the bounds of each text's, and each text's log score."""
        if len(self.seen) > KEEP:
            self._reset()
        tokens, bounds, get = [], [0], self.seen.__getitem__
        for t in texts:
            if t:
                parts = t.split(" ")
                if not self.p.by_chunk:
                    parts = [t.replace(" ", MARK)]
                elif "" in parts or MARK in t:
                    parts = [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK))]
                tokens.append(np.fromiter(map(get, parts), np.int64, len(parts)))
            else:
                tokens.append(np.zeros(0, np.int64))
            bounds.append(bounds[-1] + len(tokens[-1]))
        self._solve()
        tok = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        count = self.count[tok]
        upto = np.concatenate([[0], np.cumsum(count)])
        where = np.arange(upto[-1]) + np.repeat(self.start[tok] - upto[:-1], count)
        cost = np.concatenate([[0.0], np.cumsum(self.cost[tok])])
        bounds = np.array(bounds)
        each = np.array([math.fsum(self.cost[t]) for t in tokens]) if tokens else cost[:0]
        return (np.asarray(self.flat, np.int32)[where] if len(where) else np.zeros(0, np.int32)), upto[bounds], each


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    at = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(lengths):
        yield at, len(lengths)


def _spellings(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' bytes in a row, and each one's start and length."""
    size = np.array([len(x) for x in pieces.raw])
    return np.frombuffer(b"".join(pieces.raw), np.uint8), np.cumsum(size) - size, size


def _spell(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The texts that ids spell, each between two bounds."""
    flat, start, size = table
    upto = np.concatenate([[0], np.cumsum(size[ids])])
    text = flat[np.arange(upto[-1]) + np.repeat(start[ids] - upto[:-1], size[ids])].tobytes() if len(ids) else b""
    at = upto[bounds]
    return [text[x:y].removeprefix(b" ").decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:])]


def encode(docs: DataFrame, pieces: Pieces | None = None, check: bool = False) -> DataFrame:
    """docs with piece_ids array<int> and log_score, the best path's score.

    A null text has null piece_ids and log_score; an empty one has no pieces and score 0.
    Texts are encoded whole. check adds round_trip: whether the pieces, decoded in the same
    task, give the text back. Columns of docs with these names are replaced.
    """
    pieces = pieces or load(default_model())
    more = ["piece_ids", "log_score"] + ["round_trip"] * check
    kept = docs.drop(*more)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, _spellings(pieces)))  # one model: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = Encoder(shared.value[0]), shared.value[1]
        for b in batches:
            at = b.schema.get_field_index("text")
            sizes = [x or 0 for x in pa.compute.binary_length(b.column(at)).to_pylist()]
            for i, j in _slices(sizes, SLICE):
                part = b.slice(i, j - i)
                texts = part.column(at).to_pylist()
                flat, bounds, cost = enc.encode([t or "" for t in texts])
                null = np.array([t is None for t in texts], bool)
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat), mask=pa.array(null))
                same = [pa.array([x == (t or "") for x, t in zip(_spell(table, flat, bounds), texts)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(cost, mask=null), *same], [*part.schema.names, *more])

    added = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("log_score", T.DoubleType())] + [T.StructField("round_trip", T.BooleanType())] * check
    schema = T.StructType([*kept.schema.fields, *added])
    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """encoded with decoded, the text that piece_ids spell: markers become spaces, the one
    in front goes, byte pieces become bytes (invalid UTF-8: U+FFFD). Null ids: null."""
    pieces = pieces or load(default_model())
    kept = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(_spellings(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index("piece_ids"))
            sizes = [x or 0 for x in pa.compute.list_value_length(col).to_pylist()]
            for i, j in _slices(sizes, SLICE):
                part, lists = b.slice(i, j - i), col.slice(i, j - i)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                out = _spell(shared.value, ids, np.concatenate([[0], np.cumsum(sizes[i:j])]).astype(np.int64))
                null = lists.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string(), mask=null)], [*part.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_hash, log_score, round_trip) of docs encoded and decoded."""
    pieces = pieces or load(default_model())
    # The text stays behind after encoding: its hash is enough to compare.
    marked = docs.select("doc_id", "text", F.sha2("text", 256).alias("_sha"))
    both = decode(encode(marked, pieces).drop("text"), pieces)
    # Byte pieces stand in one run of ids.
    ids = pieces.byte_id[pieces.byte_id >= 0]
    lo, hi = (int(ids.min()), int(ids.max())) if len(ids) else (0, -1)
    return both.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.size(F.filter("piece_ids", lambda x: x.between(lo, hi))).cast("long").alias("n_byte_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        "log_score",
        F.sha2("decoded", 256).eqNullSafe(F.col("_sha")).alias("round_trip"),
    )
