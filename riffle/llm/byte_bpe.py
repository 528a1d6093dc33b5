"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The driver reads the rank file and broadcasts its entries (a vocabulary, so of bounded
size); tasks build the encoder from them. A long text isn't given to the library at once:
it is cut at safe boundaries, where a match of the pattern ends and another begins
whatever stands further left or right, so that the parts' ids in a row are the text's.
Safe is the place between a character other than white space and white space: matches
hold white space only in front. A very long run of white space, on which the library's
pattern would overflow its stack, is one match but for its last character, and is merged
as a single piece. Decoding joins the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters given to the library at once, where a safe boundary allows; white space in a row that it sees at most.
PART, RUN = 100_000, 512
#: The characters of Unicode's White_Space property, as the pattern's \s knows them.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_EDGE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
_LONG_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")


def default_ranks() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """text in parts cut at safe boundaries, and whether a part is one match of white space.

    Without a boundary after PART characters a part goes on to the next one."""
    at = 0
    for run in [*_LONG_RUN.finditer(text), None]:
        # In front of other characters, the last white space of a run belongs to the next match or is one itself.
        a, b = (run.start(), run.end() - (run.end() < len(text))) if run else (len(text), len(text))
        while at < a:
            edge = _EDGE.search(text, at + PART, a) if a - at > PART else None
            end = edge.start() if edge else a
            yield text[at:end], False
            at = end
        if b > at:
            yield text[at:b], True
            at = b


class Codec:
    """tiktoken with a vocabulary and no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.lib = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of text, unsigned."""
        found = [
            np.array(self.lib._encode_single_piece(part), np.uint32) if single else self.lib.encode_to_numpy(part, disallowed_special=())
            for part, single in parts(text)
        ]
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.lib.decode_bytes(ids.tolist())


def _codec(docs: DataFrame, path: str | None, pattern: str | None):
    """A function that gives a task its Codec."""
    vocabulary = (read_ranks(path or default_ranks()), pattern or default_pattern())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return lambda: Codec(*shared.value)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ids array<int>, the tokens of the whole text; null and empty texts have none.

    path: a rank file that the driver can read; pattern: the expression whose matches are
    merged each by itself. Each row is encoded by itself, so repeated rows repeat their
    ids. A column of docs named ids is replaced."""
    kept, codec = docs.drop("ids"), _codec(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec()
        for b in batches:
            ids = [tok.encode(t.as_py() or "").astype(np.int32) for t in b.column("text")]
            bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "ids"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded, the raw bytes that ids stand for, which needn't be UTF-8; null
    ids give null. An id that the rank file lacks, or a null among the ids, is an error."""
    kept, codec = encoded.drop("decoded"), _codec(encoded, path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec()
        for b in batches:
            out = [None if x is None else tok.decode(np.array(x, np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs: its text encoded,
    and the ids decoded, in one task, so that neither is shuffled or kept."""
    codec = _codec(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec()
        for b in batches:
            count, coded, plain = [], [], []
            for t in b.column(1):
                ids = tok.encode(t.as_py() or "")
                count.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                plain.append(hashlib.sha256(tok.decode(ids)).hexdigest())
            cols = [b.column(0), pa.array(count, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *schema]))
