"""SimHash near-duplicates by multi-index hashing.

Fingerprint: 64 bits, one where over half of the shingles' XXH64 values have it set. Two
fingerprints link when at most ``BITS`` = 2 bits differ. The fingerprint is cut into two halves; if
two differ in at most 2 bits, then either the low halves are equal or the high halves differ in at
most one bit. So the table of low halves is probed with the half itself, that of the high halves with its Hamming
ball of radius 1 (only flips from 0 to 1: of two halves that differ in one bit, one has the 0).
Fetched fingerprints are compared in full.

Work is on distinct fingerprints, so copies cost nothing beyond one row. Within a bucket a spanning
forest is emitted, never the pairs. A half that more than ``hot`` fingerprints share has its buckets
dealt out by thirds of the other half: a link in such a bucket leaves one third equal.

Null and empty texts have no words: fingerprint zero, linked like any other. Null ids take part by
text; the component id is the smallest non-null id (null if there is none). Repeated rows come back
once each. Further columns are ignored. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import multi_groups, only, staged
from .components import components

SHINGLE, BITS, SEED, HOT = 3, 2, 42, 1024
_STEP = 1 << 16  # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only \x09-\x0D and \x20 separate
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _STEP):
        hashes = [digest(join(words[k : k + shingle]), SEED) for k in range(lo, min(n, lo + _STEP))]
        octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text, to tell rows of one id apart), fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _forest(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the link graph on distinct fingerprints."""
    a, b, rest = [], [], fps
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        node = queue.pop()
        near = np.bitwise_count(rest ^ np.uint64(node)) <= bits
        if near.any():
            found = rest[near].tolist()
            a += [node] * len(found)
            b += found
            queue += found
            rest = rest[~near]
    return a, b


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in multi_groups(batches, ["part", "key", "sub"]):
            own = group.column("own").to_numpy()
            if not own.any():
                continue
            fps = np.unique(group.column("fp").to_numpy()).view(np.uint64)
            a, b = _forest(fps, bits)
            if a:
                cols = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)]
                yield pa.record_batch(cols, names=["a", "b"])

    return run


def probes(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows part, key, sub, fp, own: the table entries (own) and the probes into them."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", high.alias("high"), low.alias("low"))
    ball = F.expr("transform(filter(sequence(0, 31), i -> (high & shiftleft(1L, i)) = 0), i -> high | shiftleft(1L, i))")
    entry = lambda part, key: F.struct(F.lit(part).alias("part"), key.alias("key"), F.lit(True).alias("own"))
    rows = halves.select(
        "fp",
        F.explode(
            F.concat(
                F.array(entry(0, F.col("high")), entry(1, F.col("low"))),
                F.transform(ball, lambda k: F.struct(F.lit(0).alias("part"), k.alias("key"), F.lit(False).alias("own"))),
            )
        ).alias("_r"),
    ).select("fp", "_r.*")
    sizes = [halves.groupBy(c).count().where(F.col("count") > hot).select(F.lit(i).alias("part"), F.col(c).alias("key")) for i, c in enumerate(("high", "low"))]
    large = sizes[0].union(sizes[1])
    # a bucket next to a large half gets that half's probes, so it is dealt out as well
    around = F.expr("concat(array(key), if(part = 0, transform(sequence(0, 31), i -> key ^ shiftleft(1L, i)), array()))")
    large = staged(large.select("part", F.explode(around).alias("key")).distinct(), "large-halves")
    if large.isEmpty():
        return rows.withColumn("sub", F.lit(-1).cast("long"))
    other = F.expr("if(part = 0, fp & 4294967295L, shiftrightunsigned(fp, 32))")
    third = [other.bitwiseAND(F.lit(0x7FF)), F.shiftright(other, 11).bitwiseAND(F.lit(0x7FF)) + 2048, F.shiftright(other, 22) + 4096]
    dealt = F.when(F.col("_large"), F.array(*third)).otherwise(F.array(F.lit(-1).cast("long")))
    rows = rows.join(large.withColumn("_large", F.lit(True)), ["part", "key"], "left")
    return rows.select("part", "key", F.explode(dealt).alias("sub"), "fp", "own")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """doc_id, text_key, fp (signed long), root (the component's smallest fp), component_id."""
    if not 0 <= bits <= 2:
        raise ValueError("the halves are probed for distances up to 2")
    seen = staged(fingerprints(docs, shingle), "fingerprints")
    classes = staged(seen.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    table = probes(classes.select("fp"), hot).select("part", "key", "sub", "fp", "own")
    edges = table.repartition("part", "key", "sub").sortWithinPartitions("part", "key", "sub").mapInArrow(_links(bits), "a long, b long")
    roots = components(edges)
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    classes = staged(classes, "rooted")
    named = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = staged(classes.join(staged(named, "named"), "root").select("fp", "root", "component_id"), "class-ids")
    return seen.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``found`` (near_duplicates of the same rows): that with the smallest
    id (null after all others), of several texts under that id the one with the smallest key."""
    rows = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("k"))
    first = rows.select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    copies = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count("*").alias("_n"))
    same = F.col("f._id").eqNullSafe(F.col("c._id")) & (F.col("f._key") == F.col("c._key"))
    first = staged(first.alias("f").join(copies.alias("c"), same).select("f._id", "f._key", "_n"), "representatives")
    cols = docs.columns
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    kept = docs.join(first, here)
    # rows that repeat id and text are rare: only they are compared
    again = kept.where("_n > 1").dropDuplicates(["_id", "_key"])
    return kept.where("_n = 1").unionByName(again).select(*cols)


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
