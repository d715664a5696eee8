"""Signal features: packing, standardisation, statistics, patches, lead combination, autocorrelation.

Two forms (SURVEY 1.1):

- long   ``(record_id, lead, t, v)``: one sample per row; every operator here that
  takes the long form is an aggregation or a join against per-series aggregates,
  so it partial-aggregates and never pulls a whole series into one task.
- packed ``(record_id, lead, v array<double>)``: one series per row, sorted by t.
  A recording has a fixed, bounded length (12 leads x 5000 samples in the
  reference's domain), so one series fits in a row; after packing, per-series
  operators are higher-order functions with no further shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequery.functions.arrays import replicate_pad
from wavequery.schemas import TOP_K_LAGS


# ----------------------------------------------------------------------------- pack / unpack (PRJ-14, PRJ-15)

def check_series_length(long: DataFrame, keys: list[str], max_len: int) -> int:
    """Longest series (a partial aggregation); raises before anything is collected if it exceeds ``max_len``."""
    longest = long.groupBy(*keys).count().agg(F.max("count")).collect()[0][0] or 0
    if longest > max_len:
        raise ValueError(f"a series has {longest} samples, above max_len={max_len}; use the long-form operators")
    return longest


def pack(long: DataFrame, keys: list[str], t: str = "t", v: str = "v", check: bool = True,
         max_len: int | None = None) -> DataFrame:
    """Long -> packed: (keys..., v array<double>, n). Rejects gaps and duplicate time indexes.

    One series becomes one row, so a series must be bounded; with ``max_len`` the
    bound is verified first (a cheap aggregation) and an over-long series fails
    loudly instead of being collected into one task.
    """
    if max_len is not None:
        check_series_length(long, keys, max_len)
    agg = long.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(v).cast("double").alias("v")))).alias("_s"),
        F.min(t).alias("_t0"),
        F.max(t).alias("_t1"),
        F.count(F.lit(1)).alias("n"),
    )
    if check:
        ok = (F.col("_t0") == 0) & (F.col("_t1") == F.col("n") - 1) & (F.size(F.array_distinct(F.col("_s.t"))) == F.col("n"))
        agg = agg.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("series has gaps or duplicate time indexes"))))
    return agg.select(*keys, F.col("_s.v").alias(v), "n")


def unpack(packed: DataFrame, keys: list[str], v: str = "v", t: str = "t") -> DataFrame:
    """Packed -> long via posexplode."""
    return packed.select(*keys, F.posexplode(v).alias(t, v)).withColumn(t, F.col(t).cast("bigint"))


# ----------------------------------------------------------------------------- standardisation (AGG-3/4, PRJ-12, JN-6)

def scaler_params(long: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Per-series mean and population std; a zero std is replaced by 1 (no division by zero)."""
    std = F.stddev_pop(F.col(v).cast("double"))
    return long.groupBy(*keys).agg(
        F.avg(F.col(v).cast("double")).alias("mean"),
        F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"),
        (std == 0).alias("flat"),
    )


def zscore(long: DataFrame, keys: list[str], v: str = "v", out: str = "z", scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """AGG-4: z-score each sample with its own series' parameters (JN-6); returns (scaled, params).

    ``scale=False`` passes values through (UDF-3). Params are joined back on the
    series key (unique on that side), so a very long series is split by AQE's
    skew handling rather than landing in one task.
    """
    params = scaler_params(long, keys, v)
    if not scale:
        return long.withColumn(out, F.col(v).cast("double")), params
    scaled = long.join(params, keys).withColumn(out, (F.col(v) - F.col("mean")) / F.col("std"))
    return scaled, params


def affine(x, mean, std) -> Column:
    """PRJ-12 forward with given parameters; no zero guard -> try_divide gives null."""
    return F.try_divide(_c(x) - _c(mean), _c(std))


def affine_inverse(z, mean, std) -> Column:
    """PRJ-12 inverse: z * std + mean."""
    return _c(z) * _c(std) + _c(mean)


def inverse_zscore(scaled: DataFrame, params: DataFrame | None = None, keys: list[str] | None = None, z: str = "z", out: str = "v_back") -> DataFrame:
    """Inverse with each series' *own* parameters (the reference reuses the last fitted one): those that ``zscore`` left in
    the rows, or ``params`` joined on ``keys``."""
    if params is not None:
        scaled = scaled.drop("mean", "std", "flat").join(params, keys)
    return scaled.withColumn(out, affine_inverse(z, "mean", "std"))


def zscore_packed(packed: DataFrame, v: str = "v", out: str = "z") -> DataFrame:
    """Packed form: mean/std by ``aggregate`` inside the row, no shuffle. Both are bound once per row."""
    n = F.size(v).cast("double")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)

    def scaled(mean: Column) -> Column:
        var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
        std = F.when(F.sqrt(var) == 0, 1.0).otherwise(F.sqrt(var))
        return F.transform(F.array(std), lambda s: F.transform(v, lambda x: (x - mean) / s))[0]

    return packed.withColumn(out, F.transform(F.array(total / n), scaled)[0])


# ----------------------------------------------------------------------------- statistics (AGG-5/6/7, WIN-2)

#: Fractions at which a series is sketched: close to the middle first, then evenly. A sketch may be off by one sample in ``_ACCURACY``, far
#: less than the fractions are apart, so that a round leaves about a sixtieth of what it starts from.
_MIDDLE, _EVENLY, _ACCURACY = [0.0, 0.498, 0.5, 0.502, 1.0], [i / 128 for i in range(129)], 2000


def _sketch(v: str | Column, fractions: list[float]) -> Column:
    return F.percentile_approx(v, F.array(*[F.lit(f) for f in fractions]), _ACCURACY)


def series_stats(long: DataFrame, keys: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """min, max, lower median, trend (= sum of first differences = last - first), length.

    The trend telescopes to ``max_by(v, t) - min_by(v, t)``, so all but the median are partial
    aggregates and no window over the series is needed. The median (the lower one; null samples do not count)
    is selected by ``kth_smallest``, which splits a series of any size and starts from a sketch taken in the same pass.
    NaN propagates: any NaN sample makes the statistics NaN.
    """
    from wavequery.operators.ordering import same
    from wavequery.session import written

    x = F.col(v).cast("double")
    nan = F.lit(float("nan"))
    number = lambda c: F.when(F.col("_nan"), nan).otherwise(F.col(c)).alias(c)
    stats = long.groupBy(*keys).agg(
        F.coalesce(F.max(F.isnan(x)), F.lit(False)).alias("_nan"),
        F.min(x).alias("min_v"),
        F.max(x).alias("max_v"),
        (F.max_by(x, t) - F.min_by(x, t)).alias("trend"),
        F.count(F.lit(1)).alias("n"),
        F.count(x).alias("_n"),
        _sketch(x, _MIDDLE).alias("_q"),
    )
    stats = written(stats, "statistics")
    rows = long.select(*keys, x.alias("_v")).where(F.col("_v").isNotNull())
    sketch = stats.where("_n > 0").select(*keys, "_n", F.ceil(F.col("_n") / 2).alias("_k"), "_q")
    median = kth_smallest(rows, keys, "_v", sketch, _MIDDLE).withColumnRenamed("_v", "median_v")
    return same(stats, median, keys, "left").select(*keys, *[number(c) for c in ("min_v", "max_v", "median_v", "trend")], "n")


def lower_median(long: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Exact lower median (sample ceil(n/2) of n by value) for series of any size: (keys..., median_v). Nulls do not count."""
    rows = long.select(*keys, F.col(v).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), _sketch("_v", _MIDDLE).alias("_q"))
    sketch = sketch.withColumn("_k", F.ceil(F.col("_n") / 2))
    return kth_smallest(rows, keys, "_v", sketch, _MIDDLE).withColumnRenamed("_v", "median_v")


def kth_smallest(rows: DataFrame, keys: list[str], v: str, sketch: DataFrame, fractions: list[float]) -> DataFrame:
    """Exact selection without a sort: (keys..., v), the value of rank ``_k`` (from 1) among the ``_n`` of each series.
    ``sketch``: keys..., _n, _k and ``_q``, the series' values at the ``fractions`` by a mergeable sketch (a partial aggregate).

    A round takes the two sketched values around the wanted rank and counts the values below, at, between and above them. The
    counts are exact: they say whether one of the two is the answer, or which of the other parts holds it and at which rank. Only that part,
    a small share of the series, is sketched for the next round; a sketch that errs costs a round, never a wrong answer. Each round drops the
    two values with all their ties.
    """
    from wavequery.operators.ordering import same
    from wavequery.session import written

    answers = None
    while True:
        at = F.array(*[F.lit(f) for f in fractions])
        near = F.size(F.filter(at, lambda f: f * F.col("_n") < F.col("_k")))  # fractions below the rank
        low = F.get("_q", F.greatest(near - 1, F.lit(0)))
        high = F.get("_q", F.least(near, F.lit(len(fractions) - 1)))
        bounds = sketch.select(*keys, F.col("_k").cast("bigint").alias("_k"), low.alias("_lo"), high.alias("_hi"))
        x, lo, hi = F.col(v), F.col("_lo"), F.col("_hi")
        part = F.when(x < lo, 0).when(x == lo, 1).when(x < hi, 2).when(x == hi, 3).otherwise(4)
        counted = same(rows, bounds, keys).groupBy(*keys).agg(
            F.first("_k").alias("_k"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), *[F.count_if(part == i).alias(f"_c{i}") for i in range(5)]
        )
        upto = [sum((F.col(f"_c{j}") for j in range(i)), F.lit(0)) for i in range(6)]
        where = F.when(F.col("_k") <= upto[1], 0)
        for i in range(1, 5):
            where = where.when(F.col("_k") <= upto[i + 1], i)
        before = F.element_at(F.array(*upto[:5]), F.col("_part") + 1)
        found = written(counted.withColumn("_part", where).select(*keys, "_part", (F.col("_k") - before).alias("_k"), "_lo", "_hi"), "selected")
        done = found.where("_part in (1, 3)").select(*keys, F.when(F.col("_part") == 1, lo).otherwise(hi).alias(v))
        answers = done if answers is None else answers.unionByName(done)
        left = found.where("_part in (0, 2, 4)")
        if left.isEmpty():
            return answers
        rows = written(same(rows, left, keys).where(part == F.col("_part")).select(*keys, v), "narrowed")
        fractions = _EVENLY
        sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), _sketch(v, fractions).alias("_q"))
        sketch = written(same(sketch, left.select(*keys, "_k"), keys), "sketches")


def first_differences(long: DataFrame, keys: list[str], t: str = "t", v: str = "v", chunk: int = 1 << 16) -> DataFrame:
    """WIN-2: v - previous v within the series (null for the first sample).

    Samples are numbered globally in (keys, t) order and cut into chunks of ``chunk`` positions; a chunk
    also gets the last sample before it. The window runs per chunk, so a huge series is split.
    """
    from pyspark.sql import Window

    from wavequery.operators.ordering import with_positions

    rows = with_positions(long, [*keys, t], pos="_pos").df
    own = rows.withColumn("_chunk", F.floor(F.col("_pos") / chunk)).withColumn("_edge", F.lit(False))
    edge = rows.where((F.col("_pos") + 1) % chunk == 0)
    edge = edge.withColumn("_chunk", F.floor(F.col("_pos") / chunk) + 1).withColumn("_edge", F.lit(True))
    before = F.lag(F.struct(*keys, F.col(v).alias("_v"))).over(Window.partitionBy("_chunk").orderBy("_pos"))
    both = own.unionByName(edge).withColumn("_before", before).where(~F.col("_edge"))
    same = F.col("_before").isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_before.{k}"))
    return both.withColumn("dv", F.when(same, F.col(v) - F.col("_before._v"))).select(*long.columns, "dv")


def series_stats_packed(packed: DataFrame, v: str = "v") -> DataFrame:
    """Packed form of ``series_stats``: sort inside the row, no shuffle."""
    s = F.sort_array(v)
    n = F.size(v)
    number = lambda x: F.when(F.exists(v, F.isnan), F.lit(float("nan"))).otherwise(x)  # noqa: E731  NaN propagates
    return packed.select(
        "*",
        number(F.array_min(v)).alias("min_v"),
        number(F.array_max(v)).alias("max_v"),
        number(F.get(s, (F.ceil(n / 2) - 1).cast("int"))).alias("median_v"),
        number(F.element_at(v, -1) - F.get(v, 0)).alias("trend"),
    )


# ----------------------------------------------------------------------------- patches (WIN-3, WIN-4)

def patch_count(n: Column, patch_len: int, stride: int) -> Column:
    """Patches after padding by ``stride``: floor((n + stride - patch_len) / stride) + 1, or 0 when too short."""
    room = n + stride - patch_len
    return F.when(room >= 0, F.floor(room / stride) + 1).otherwise(0).cast("int")


def patches_packed(packed: DataFrame, patch_len: int, stride: int, v: str = "v") -> DataFrame:
    """Packed: replicate-pad the last value ``stride`` times, then count-based windows -> array<array<double>>."""
    padded = replicate_pad(v, stride)
    n_p = patch_count(F.size(v), patch_len, stride)
    # the padded series is bound once per row, not rebuilt for every patch
    cut = lambda whole: F.transform(F.sequence(F.lit(0), n_p - 1), lambda p: F.slice(whole, p * stride + 1, patch_len))
    windows = F.when(n_p > 0, F.transform(F.array(padded), cut)[0]).otherwise(F.array().cast("array<array<double>>"))
    return packed.withColumn("patches", windows)


def patches_long(long: DataFrame, keys: list[str], patch_len: int, stride: int, t: str = "t", v: str = "v") -> DataFrame:
    """Long: (keys..., patch_id, offset, v) without packing.

    Each sample is copied into the <= ceil(P/S) patches that contain it; the S
    padding samples per series are generated from the series' last value; the
    series length (to drop windows past the padded end) comes from a per-series
    aggregate joined back. No group is collected.
    """
    info = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max_by(v, t).alias("_last"))
    pad = info.select(
        *keys, F.explode(F.sequence(F.col("_n"), F.col("_n") + stride - 1)).alias(t), F.col("_last").alias(v), "_n"
    )
    body = long.select(*keys, t, v).join(info.select(*keys, "_n"), keys)
    samples = body.unionByName(pad)
    k_max = -(-patch_len // stride)  # a sample sits in at most ceil(P/S) patches
    first_p = F.greatest(F.lit(0), F.floor((F.col(t) - patch_len + stride) / stride)).cast("bigint")
    memb = samples.withColumn("_p", F.explode(F.sequence(first_p, first_p + (k_max - 1))))
    memb = memb.withColumn("offset", (F.col(t) - F.col("_p") * stride).cast("int"))
    n_p = patch_count(F.col("_n"), patch_len, stride)
    memb = memb.where((F.col("offset") >= 0) & (F.col("offset") < patch_len) & (F.col("_p") < n_p))
    return memb.select(*keys, F.col("_p").alias("patch_id"), "offset", F.col(v).cast("double").alias(v))


# ----------------------------------------------------------------------------- lead combination (WIN-5, JN-8)

def combine_leads(long: DataFrame, weights: DataFrame, record: str = "record_id", lead: str = "lead", t: str = "t",
                  v: str = "v", taps: int = 3, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Circular ``taps``-tap stencil over leads: y[t] = sum_c sum_k w[c,k] * x_c[(t + k - taps//2) mod T_c].

    ``weights`` is a supplied (lead, k, w) table; up to ``broadcast_rows`` (a few ten MB) it is
    broadcast, a larger one is joined by shuffling. Each sample contributes to ``taps`` outputs, so the work is
    an explode + one partial aggregation; a lead wraps around its own length T_c.
    """
    if weights.count() <= broadcast_rows:  # the broadcast side is checked, not assumed, to be small
        weights = F.broadcast(weights)
    half = taps // 2
    lens = long.groupBy(record, lead).agg(F.count(F.lit(1)).alias("_T"))
    x = long.join(lens, [record, lead])
    contrib = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(taps - 1)))).join(weights, [lead, "k"])
    # sample at t feeds output t' with (t' + k - half) mod T = t
    target = F.pmod(F.col(t) - F.col("k") + half, F.col("_T"))
    return contrib.groupBy(record, target.alias(t)).agg(F.sum(F.col("w") * F.col(v)).alias("y"))


# ----------------------------------------------------------------------------- autocorrelation (AGG-17, TOP-5)

def _top_lags(series: pd.Series, k: int = TOP_K_LAGS) -> pd.Series:
    out = []
    for arr in series:
        x = np.asarray(arr, dtype=np.float64)
        n = x.size
        if n == 0:
            out.append([])
            continue
        if np.isnan(x).any():  # every lag's value is NaN: there is no order to report
            out.append(None)
            continue
        f = np.fft.rfft(x)
        c = np.fft.irfft(f * np.conj(f), n=n)  # true circular autocorrelation for every n
        c = (c + np.roll(c[::-1], 1)) / 2.0  # c[tau] == c[n - tau] exactly
        energy = float(x @ x)
        key = np.rint(c / (energy if energy != 0 else 1.0) * 1e9)
        order = np.lexsort((np.arange(n), -key))  # value desc, then lag asc
        out.append(order[: min(k, n)].astype(np.int64).tolist())
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def top_lags_udf(v: pd.Series) -> pd.Series:
    """Arrow-batched: top-5 lags of each packed series by circular autocorrelation."""
    return _top_lags(v)


def autocorr_top_lags(packed: DataFrame, v: str = "v", out: str = "lags") -> DataFrame:
    """AGG-17 + TOP-5 on packed series (FFT, O(T log T) per series, inside Arrow batches).

    Pack with ``pack(..., max_len=MAX_FFT_SAMPLES)`` so every series is bounded.
    """
    return packed.withColumn(out, top_lags_udf(F.col(v)))


# A packed series is one row and one in-memory FFT: 2^22 doubles = 32 MiB.
MAX_FFT_SAMPLES = 1 << 22


def top_lags_long(long: DataFrame, keys: list[str], t: str = "t", v: str = "v", max_len: int = MAX_FFT_SAMPLES, cells: int = 1 << 20) -> DataFrame:
    """AGG-17 + TOP-5 for series of any length: (keys..., lags). Series of up to ``max_len`` samples are transformed in one
    task each, longer ones by ``autocorr_top_lags_distributed``; values are rounded alike."""
    from wavequery.operators.ordering import same
    from wavequery.session import written

    rows = long.select(*keys, F.col(t).alias("t"), F.col(v).cast("double").alias("v"))
    lens = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (lens.agg(F.max("_n")).first()[0] or 0) <= max_len:
        return autocorr_top_lags(pack(rows, keys)).select(*keys, "lags")
    sized = same(written(rows, "series"), lens, keys)
    short = autocorr_top_lags(pack(sized.where(F.col("_n") <= max_len).drop("_n"), keys)).select(*keys, "lags")
    return short.unionByName(autocorr_top_lags_distributed(sized.where(F.col("_n") > max_len).drop("_n"), keys, cells))


def _factors(n: int, cells: int) -> tuple[int, int, int, int]:
    """Sides of the transform of a series of n samples, padded to a power of two of at least 2n: rows N1 and columns N2, and the
    columns C and rows R that one task holds, of up to ``cells`` numbers."""
    p = (2 * n - 1).bit_length()
    n1, n2 = 1 << p // 2, 1 << p - p // 2
    return n1, n2, max(1, min(n2, cells // n1)), max(1, min(n1, cells // n2))


def _twiddles(rows: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray:
    return np.exp(-2j * np.pi * (rows[:, None] * columns % size) / size)


def _top_lags_transform(table: pa.Table, keys: list[str], cells: int, step: str) -> pa.Table:
    """One group of one step of the four-step transform: see ``autocorr_top_lags_distributed``."""
    n = table.column("_n")[0].as_py()
    n1, n2, c, r = _factors(n, cells)
    whole = lambda axis: np.concatenate(
        [np.frombuffer(x, dtype=np.complex128).reshape(-1, c) for x in table.sort_by("_at").column("_data").to_pylist()], axis=axis
    )

    def out(group: list[int], at: int, parts: list[np.ndarray]) -> pa.Table:
        same = [pa.array([table.column(k)[0].as_py()] * len(parts), table.schema.field(k).type) for k in keys]
        data = pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())
        return pa.table([*same, pa.array([n] * len(parts)), pa.array(group, pa.int64()), pa.array([at] * len(parts), pa.int64()), data], names=[*keys, "_n", "_g", "_at", "_data"])

    g = table.column("_g")[0].as_py()
    if step == "columns":
        t, v = table.column("_t").to_numpy(), table.column("_v").to_numpy()
        if len(np.unique(t)) < len(t):
            raise ValueError("series has gaps or duplicate time indexes")
        x = np.zeros((n1, c))
        x[t // n2, t % n2 - g * c] = v
        a = np.fft.fft(x, axis=0) * _twiddles(np.arange(n1), g * c + np.arange(c), n1 * n2)
        return out(list(range(n1 // r)), g, [a[i * r : (i + 1) * r] for i in range(n1 // r)])
    if step == "rows":
        power = np.abs(np.fft.fft(whole(1), axis=1)) ** 2
        b = np.fft.ifft(power, axis=1) * _twiddles(g * r + np.arange(r), np.arange(n2), n1 * n2).conj()
        return out(list(range(n2 // c)), g, [b[:, i * c : (i + 1) * c] for i in range(n2 // c)])
    products = np.fft.ifft(whole(0), axis=0).real
    lag = (np.arange(n1)[:, None] * n2 + (g * c + np.arange(c))).ravel()
    keep = lag < n
    lag, products = lag[keep], products.ravel()[keep]
    products = np.where(2 * lag == n, 2 * products, products)  # its own mirror
    same = [pa.array([table.column(k)[0].as_py()] * len(lag), table.schema.field(k).type) for k in keys]
    return pa.table([*same, pa.array(np.full(len(lag), n)), pa.array(np.minimum(lag, n - lag)), pa.array(products)], names=[*keys, "_n", "_lag", "_r"])


def autocorr_top_lags_distributed(long: DataFrame, keys: list[str], cells: int = 1 << 20, k: int = TOP_K_LAGS) -> DataFrame:
    """The same lags from (keys..., t, v) for a series of any length, no task holding more than ``cells`` of its numbers: (keys..., lags).

    A four-step Fourier transform. The series, padded with zeros to N = N1 * N2 >= 2n numbers, is a matrix of N1 rows:
    1. tasks of some columns each transform them and multiply by the twiddle factors;
    2. the matrix is transposed by a shuffle; tasks of some rows each transform them, take the power spectrum and
       transform that back along the same rows, so that no further transpose is needed;
    3. shuffled back to columns, the inverse transform of those gives the products at all lags.
    The products at tau and n - tau add up to the circular value of both. Work is O(n log n) and linear in the number of tasks.
    """
    from pyspark.sql import Window

    from wavequery.operators.ordering import same

    cells = 1 << cells.bit_length() - 1  # a power of two, as the sides are
    info = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("t").alias("_t0"), F.max("t").alias("_t1"),
        F.max(F.col("v").isNull() | F.isnan("v")).alias("_nan"), F.sum(F.col("v") * F.col("v")).alias("_c0"),
    )
    whole = (F.col("_t0") == 0) & (F.col("_t1") == F.col("_n") - 1)
    rows = same(long, info, keys).where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("series has gaps or duplicate time indexes"))))
    # the sides of _factors: the length in bits of 2n - 1
    p = F.length(F.bin(F.col("_n") * 2 - 1))
    n1, n2 = (F.expr(f"shiftleft(1L, int({x}))") for x in ("_p div 2", "_p - _p div 2"))
    columns = F.greatest(F.lit(1), F.least(n2, F.expr(f"{cells}L div shiftleft(1L, int(_p div 2))")))
    rows = rows.where(~F.col("_nan")).withColumn("_p", p).select(
        *keys, "_n", F.floor(F.pmod("t", n2) / columns).alias("_g"), F.col("t").cast("long").alias("_t"), F.col("v").cast("double").alias("_v")
    )
    types = ", ".join(f"`{c}` {long.schema[c].dataType.simpleString()}" for c in keys)

    def step(df: DataFrame, name: str, schema: str) -> DataFrame:
        return df.groupBy(*keys, "_g").applyInArrow(lambda table: _top_lags_transform(table, keys, cells, name), f"{types}, _n long, {schema}")

    parts = "_g long, _at long, _data binary"
    products = step(step(step(rows, "columns", parts), "rows", parts), "lags", "_lag long, _r double")
    c = products.groupBy(*keys, "_n", "_lag").agg(F.sum("_r").alias("_c"))
    c = same(c, info.select(*keys, "_c0"), keys)
    key = F.rint(F.col("_c") / F.when(F.col("_c0") != 0, F.col("_c0")).otherwise(1.0) * 1e9)
    both = F.array_distinct(F.array(F.col("_lag"), F.pmod(F.col("_n") - F.col("_lag"), F.col("_n"))))
    ranked = c.select(*keys, key.alias("_key"), F.explode(both).alias("_lag"))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_key"), "_lag"))).where(F.col("_rank") <= k)
    lags = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", "_lag"))).alias("_s"))
    return same(info.select(*keys), lags.select(*keys, F.col("_s._lag").alias("lags")), keys, "left")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col
