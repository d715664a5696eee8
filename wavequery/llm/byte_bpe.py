"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before single blanks that stand between two non-blank characters: a match of
the pattern always starts there and none looks back, so the parts' ids follow each other exactly as
the whole text's. Parts are encoded once per worker and remembered (a bounded cache). Decoding
joins the raw bytes of the ids, so any bytes survive, also cut UTF-8 sequences.

The library's regular expressions run out of stack on about a million white-space characters in a row. A run of ``_LONG`` or more is
therefore matched here, by the pattern's own rule (all of it but the last character where more text follows), and its bytes go to the library's
merges as the one piece that they are.

Null text counts as empty; an empty text has no ids; rows are independent, so empty tables, ties and
repeated rows need no rule; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, only

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"(?:\A|\s) | (?:\s|\Z)")
_CACHE = 400_000
_LONG = 10_000
# fixed values: the characters that the library's patterns take for white space
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str) -> list[str]:
    """The text cut at its safe boundaries; each part but the first starts with the blank."""
    cuts = [0, *(m.start() for m in _SAFE.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    enc = encoding(path, pattern)

    def pack(part: str) -> bytes:
        if len(part) < _LONG:
            return np.array(enc.encode_ordinary(part), dtype="<u4").tobytes()
        out, at = [], 0
        for run in _RUN.finditer(part):
            end = run.end() if run.end() == len(part) else run.end() - 1
            out += [enc.encode_ordinary(part[at : run.start()]), enc._encode_single_piece(part[run.start() : end])]
            at = end
        out.append(enc.encode_ordinary(part[at:]))
        return b"".join(np.array(ids, dtype="<u4").tobytes() for ids in out)

    whole, tail = Memo(pack, _CACHE), Memo(lambda part: pack(" " + part), _CACHE)
    get, get_tail = whole.__getitem__, tail.__getitem__

    def ids(text: str) -> bytes:
        if _UNSAFE.search(text):
            return b"".join(map(get, safe_parts(text)))
        first, *rest = text.split(" ")
        return get(first) + b"".join(map(get_tail, rest))

    return ids


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    return _encoder(path, pattern)(text)


def decode_ids(ids: bytes, path: str, pattern: str) -> bytes:
    return encoding(path, pattern).decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [encode_text(t.as_py() or "", path, pattern) for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded (raw bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = part.column(1).to_pylist()
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        part.column(1),
                        pa.array([decode_ids(x, path, pattern) for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encoding and decoding of whole texts, returned as digests."""
    out = decode(encode(docs, path, pattern), path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
