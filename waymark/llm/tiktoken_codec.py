"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are split before encoding where the pattern always has a border (before white space that follows anything else, and
between closing punctuation and a letter), so that no call gets more than about `piece` characters unless the text has no such border. A long run
of white space is one match but for its last character, if something follows; it is cut out and goes to the merges as such, because the
library's pattern engine overflows its stack on a million of them. Ids are the same as for the whole text. Ids are decoded to raw
bytes. Null and empty texts: no ids. Repeated rows: each encoded. Empty table: no rows. Very long texts: a piece at a time. Extra columns
pass through `encode` and `decode`; their own columns replace any of the same name.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Unicode's white space, as the library's pattern takes it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_BORDER = re.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[.,;:!?。、])(?=[A-Za-z一-鿿])")
#: Runs of at least this many white-space characters are cut out.
RUN = 10_000
_RUNS = re.compile(rf"[{_SPACE}]{{{RUN},}}")


@functools.cache
def encoding(path: str, pattern: str):
    """One for each Python worker and rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, piece: int = 50_000) -> Iterator[str]:
    """text without long runs of white space, cut at safe borders."""
    at = 0
    while len(text) - at > piece:
        found = _BORDER.search(text, at + piece)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """text in parts; True marks a long run of white space that is one match of the pattern."""
    at = 0
    for run in _RUNS.finditer(text) if len(text) >= RUN else ():
        end = run.end() - (run.end() < len(text))  # the last one belongs to what follows
        if run.start() > at:
            yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


def ids_of(text: str, codec) -> list[int]:
    parts = []
    for stretch, one in stretches(text):
        parts += [codec._encode_single_piece(stretch)] if one else map(codec.encode_ordinary, pieces(stretch))
    return parts[0] if len(parts) == 1 else [i for p in parts for i in p]


def _mapped(df: DataFrame, column: str, out: str, kind: str, arrow: pa.DataType, value) -> DataFrame:
    df = df.drop(out)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                made = pa.array([value(x) for x in part.column(column)], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*names, out])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{out} {kind}"]))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids array<int>."""
    return _mapped(docs, text, "ids", "array<int>", pa.list_(pa.int32()), lambda x: ids_of(x.as_py() or "", encoding(path, pattern)))


def decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (with ids) with decoded binary: the bytes of the ids, whether or not they are UTF-8 text."""
    return _mapped(docs, "ids", "decoded", "binary", pa.binary(), lambda x: encoding(path, pattern).decode_bytes(x.values.to_pylist() if x.is_valid else []))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, and decoded from the ids, in one pass that ships no ids."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column("__text"):
                ids = ids_of(x.as_py(), codec)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(key, text_of(text).alias("__text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
