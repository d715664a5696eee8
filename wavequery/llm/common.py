"""Helpers shared by the operators: tables, staging in the shared folder, grouped Arrow streams."""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, columns stay prunable,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, **cols: str) -> DataFrame:
    """The named columns under fixed names, so that further columns of any name cannot clash.
    A name that differs only in case is told apart by an exact match where there is one."""
    picked = []
    for new, old in cols.items():
        exact = [c for c in df.columns if c == old]
        if len(exact) > 1 or (not exact and sum(c.lower() == old.lower() for c in df.columns) > 1):
            raise ValueError(f"column {old!r} is there more than once")
        if sum(c.lower() == old.lower() for c in df.columns) > 1:
            df = df.toDF(*[c if c == old else f"_x{i}" for i, c in enumerate(df.columns)])
        picked.append(F.col(f"`{old}`").alias(new))
    return df.select(*picked)


def multi_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Contiguous runs of two or more rows with equal non-null integer ``keys`` in a sorted Arrow
    stream, one table each. At most one run and one batch are held at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n - 1, dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        ends = np.concatenate([starts[1:], [n]])
        wanted = ends - starts > 1
        wanted[0] = wanted[-1] = True  # these may go on in the batch before or after
        for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist()):
            key = tuple(c[a] for c in cols)
            if held and key != held_key:
                if sum(h.num_rows for h in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = key
    if held and sum(h.num_rows for h in held) > 1:
        yield pa.Table.from_batches(held)


def portions(batch: pa.RecordBatch, column: int, rows: int = 1024, chars: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of up to ``rows`` rows with up to ``chars`` characters in the text ``column`` (or one longer text),
    with their texts; a null one is empty. No more texts than those of ``rows`` rows are held at once."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        texts = [t or "" for t in part.column(column).to_pylist()]
        lo, held = 0, 0
        for i, t in enumerate(texts):
            if i > lo and held + len(t) > chars:
                yield part.slice(lo, i - lo), texts[lo:i]
                lo, held = i, 0
            held += len(t)
        yield part.slice(lo), texts[lo:]


class Memo(dict):
    """A cache that computes what is missing and starts afresh when it has ``limit`` entries,
    so that a worker's memory stays bounded whatever it reads. Long keys are not remembered."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def as_matrix(column: pa.ChunkedArray | pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * x) as doubles; components that a shorter vector lacks are zero."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = rows.value_lengths().to_numpy(zero_copy_only=False)
    whole = np.zeros((len(lengths), int(lengths.max(initial=0))))
    whole[np.arange(whole.shape[1]) < lengths[:, None]] = np.floor(rows.flatten().to_numpy().astype(np.float64) * scale)
    return whole


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, as 64-bit integers, of the rows of ``a`` with those of ``b`` (doubles that hold integers): by
    doubles where no sum can pass 2**53, by 64-bit integers below 2**63, else by Python's own, which refuse a product beyond 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    left, right = [[[int(x) for x in row] for row in m] for m in (a, b)]
    products = [[sum(map(operator.mul, x, y)) for y in right] for x in left]
    if any(not -(2**63) <= p < 2**63 for row in products for p in row):
        raise OverflowError("an inner product of floor(scale * x) does not fit 64 bits")
    return np.array(products, dtype=np.int64).reshape(len(left), len(right))


def finite_vector(name: str) -> str:
    """SQL: the vector is there and all its components are finite numbers. An empty one is."""
    return f"{name} is not null and forall({name}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
