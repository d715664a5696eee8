"""Packing token pieces into fixed windows by non-negative least squares over length bins.

1. Texts become token ids; a document longer than the window is cut into full windows and a rest.
2. The histogram of piece lengths (in bins of ``grain`` tokens, rounded up) is the only thing the
   driver sees: at most ``window / grain`` numbers, whatever the input.
3. Shallow combinations (up to ``depth`` bins) that fill the window exactly are enumerated; repeat
   counts ``x >= 0`` minimise the weighted ``|A x - h|``; they are rounded to what the histogram holds.
4. What is left is packed greedily, again on the histogram: the largest bin first, then the largest
   that still fits, repeated as often as the counts allow.
5. Each piece takes its place by its rank within its bin. Ranks are counted per (bin, salt), so a
   length that a third of all pieces share is numbered by many tasks.

Null text counts as empty (the document is then the end id alone), empty input gives no rows,
repeated rows are packed once each, and further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, only, portions, staged

WINDOW, GRAIN, DEPTH, END_ID = 2048, 8, 3, 1

# Texts of these characters only are normalised by str.lower() just as the vocabulary file asks
# (composition has nothing to do, no character's lower case depends on its neighbours).
_PLAIN = re.compile(r"[\t-\r -~¡-ÿ]*")
_WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]"
    r"|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+"
)
_CACHE = 400_000  # distinct words remembered per worker


def _byte_alphabet() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """texts -> their ids as little-endian unsigned 32-bit bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tokenize, letters = tok.model.tokenize, _byte_alphabet()

    def word(w: str) -> bytes:
        # a normalised word of the split pattern goes to the merges as it is
        ids = [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(part: str) -> bytes:
        return np.array(tok.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    words = Memo(word, _CACHE)
    plain = lambda part: words[part] if part.isalpha() else b"".join(map(words.__getitem__, _WORDS.findall(part)))
    other = Memo(encode, _CACHE // 4).__getitem__

    def ids(texts: list[str]) -> list[bytes]:
        # nothing in the vocabulary's rules reaches across a blank, so parts between blanks are independent
        is_plain = ["<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
        lowered = iter(_by_parts([t.lower() for t, p in zip(texts, is_plain) if p], plain))
        others = iter(_by_parts([t for t, p in zip(texts, is_plain) if not p], other))
        return [next(lowered if p else others) for p in is_plain]

    return ids


def _by_parts(texts: list[str], encode: Callable[[str], bytes]) -> list[bytes]:
    """Each text's ids: those of its parts between blanks, where every distinct part is encoded once."""
    if not texts:
        return []
    parts = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
    coded = pc.dictionary_encode(parts.flatten())
    distinct = [encode(part) for part in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
    first = np.cumsum(size) - size
    at = coded.indices.to_numpy()
    size, first = size[at], first[at]
    end = np.cumsum(size)
    ids = np.frombuffer(b"".join(distinct), dtype="<u4")[np.repeat(first - (end - size), size) + np.arange(end[-1])]
    cuts = np.concatenate([[0], end])[parts.offsets.to_numpy()].tolist()
    return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and the ids' bytes if asked)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part, texts in portions(batch, 1):
                out: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)
                        out.append((*row, piece) if keep_ids else row)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                kinds = [pa.int64()] * 5
                if keep_ids:
                    names, kinds = [*names, "ids"], [*kinds, pa.binary()]
                cols = list(zip(*out)) or [()] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, schema)


def combinations(sizes: list[int], total: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``depth`` of the sizes that add up to ``total``."""
    have, out = set(sizes), []

    def grow(prefix: tuple[int, ...], room: int) -> None:
        if room in have and (not prefix or room <= prefix[-1]):
            out.append((*prefix, room))
        if len(prefix) + 1 < depth:
            for s in sizes:
                if (not prefix or s <= prefix[-1]) and s < room:
                    grow((*prefix, s), room - s)

    grow((), total)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson); at most 3 rounds per row of ``a``,
    after which the best point so far is returned."""
    m, n = a.shape
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * m):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if free.sum() >= m or w.max(initial=-np.inf) <= tol:
            break
        free[int(np.argmax(w))] = True
        while free.any():
            at = np.flatnonzero(free)
            p = a[:, at]
            z = np.linalg.solve(p.T @ p + 1e-9 * np.eye(len(at)), p.T @ b)
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            now, bad = x[at], np.flatnonzero(z <= 0)
            steps = now[bad] / np.maximum(now[bad] - z[bad], 1e-300)
            now = now + steps.min() * (z - now)
            now[bad[int(np.argmin(steps))]] = 0
            x[at] = np.where(now > 1e-12, now, 0)
            free[at] = now > 1e-12
    return x


def plan(hist: dict[int, int], bins: int, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """(pattern, repeats) rows that use up the histogram exactly; a pattern maps a bin to how often it occurs."""
    left = {b: n for b, n in hist.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], repeats: int) -> None:
        if repeats > 0:
            out.append((pattern, repeats))
            for b, k in pattern.items():
                left[b] -= k * repeats

    if bins in left:
        use({bins: 1}, left[bins])
    sizes = sorted(left)
    combos = [dict(zip(*np.unique(c, return_counts=True))) for c in combinations(sizes, bins, depth) if len(c) > 1]
    if combos:
        at = {b: i for i, b in enumerate(sizes)}
        a = np.zeros((len(sizes), len(combos)))
        for j, c in enumerate(combos):
            for b, k in c.items():
                a[at[int(b)], j] = k
        h = np.array([left[b] for b in sizes], dtype=float)
        weight = np.sqrt(np.array(sizes, dtype=float) / bins)[:, None]  # long pieces are the harder to place later
        scale = max(1.0, h.max())
        x = nnls(a * weight, h / scale * weight[:, 0]) * scale
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            pattern = {int(b): int(k) for b, k in combos[j].items()}
            use(pattern, min(int(round(x[j])), min(left[b] // k for b, k in pattern.items())))
    while any(left.values()):
        room, pattern = bins, {}
        for b in sorted((b for b, n in left.items() if n), reverse=True):
            k = min(room // b, left[b])
            if not pattern:
                k = max(1, k)
            if k:
                pattern[b] = k
                room -= k * b
        use(pattern, min(left[b] // k for b, k in pattern.items()))
    return out


def pack(pieces: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and offset to (staged) ``pieces`` with doc_id, start, length <= window."""
    spark = pieces.sparkSession
    bins = window // grain
    rows = pieces.withColumn("_bin", F.ceil(F.col("length") / grain).cast("int"))
    hist = {r["_bin"]: r["n"] for r in rows.groupBy("_bin").agg(F.count("*").alias("n")).collect()}  # <= bins rows
    if any(b > bins for b in hist):
        raise ValueError("a piece is longer than the window")
    spans, at, used = [], 0, dict.fromkeys(hist, 0)
    for pattern, repeats in plan(hist, bins, depth):
        for b, k in pattern.items():
            spans.append((b, used[b], used[b] + k * repeats, at, repeats))
            used[b] += k * repeats
        at += repeats
    # a few rows per occupied bin: bounded by window / grain, not by the data
    places = spark.createDataFrame(spans, "_bin int, _lo long, _hi long, _first long, _repeats long")
    salts = max(256, sum(hist.values()) // 100_000)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = rows.groupBy("_bin", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_bin").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_bin", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_bin", "_salt").orderBy(*[c for c in ("doc_id", "start", "ids_crc32") if c in pieces.columns])
    ranked = (
        rows.withColumn("_rank", F.row_number().over(within) - 1)
        .join(counts, ["_bin", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .join(F.broadcast(places), "_bin")
        .where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .withColumn("sequence_id", F.col("_first") + (F.col("_rank") - F.col("_lo")) % F.col("_repeats"))
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_bin"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(
        *pieces.columns, "sequence_id", "offset"
    )


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed windows themselves: sequence_id, input_ids (padded), doc_starts. Needs the ``ids`` column.
    A group holds one window of ids at most."""
    byte = "hex(substring(ids, 4 * i + {}, 1))"
    number = f"conv(concat({', '.join(byte.format(k) for k in (4, 3, 2, 1))}), 16, 10)"
    ids = F.expr(f"transform(sequence(0, int(length) - 1), i -> cast({number} as long))")
    parts = packed.select("sequence_id", F.struct("offset", "length", ids.alias("ids")).alias("_p"))
    return (
        parts.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list("_p")).alias("_p"))
        .select(
            "sequence_id",
            F.flatten(F.col("_p.ids")).alias("_ids"),
            F.col("_p.offset").alias("doc_starts"),
        )
        .select(
            "sequence_id",
            F.concat("_ids", F.array_repeat(F.lit(pad_id).cast("long"), F.lit(window) - F.size("_ids"))).alias("input_ids"),
            "doc_starts",
        )
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, keep_ids: bool = False) -> DataFrame:
    return pack(staged(token_pieces(docs, tokenizer_path, window, keep_ids=keep_ids), "pieces"), window, grain, depth)
