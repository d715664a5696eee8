import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavequery.functions import fixed4, int_list_text, trend_word
from wavequery.operators import signals as SG


def _long(spark, series: dict):
    data = [(rid, "L", t, float(v)) for rid, vals in series.items() for t, v in enumerate(vals)]
    return spark.createDataFrame(data, "record_id long, lead string, t long, v double")


def test_stats_lower_median_trend_and_constant(spark):
    df = _long(spark, {1: [1, 2, 3, 4], 2: [5, 5, 5]})
    st_ = {r.record_id: r for r in SG.series_stats(df, ["record_id"]).withColumn("w", trend_word("trend")).collect()}
    assert (st_[1].min_v, st_[1].max_v, st_[1].median_v, st_[1].trend, st_[1].w) == (1.0, 4.0, 2.0, 3.0, "upward")
    assert (st_[2].trend, st_[2].w) == (0.0, "downward")
    z, _ = SG.zscore(df, ["record_id", "lead"])
    assert all(r.z == 0.0 for r in z.where("record_id = 2").collect())
    packed = SG.pack(df, ["record_id", "lead"])
    ps = {r.record_id: r for r in SG.series_stats_packed(packed).collect()}
    assert (ps[1].median_v, ps[1].trend) == (2.0, 3.0)


def test_nan_sample_makes_stats_nan(spark):
    df = _long(spark, {1: [1.0, float("nan"), 3.0]})
    r = SG.series_stats(df, ["record_id"]).collect()[0]
    assert all(math.isnan(x) for x in (r.min_v, r.max_v, r.median_v, r.trend))


def test_zscore_inverse_is_identity(spark):
    df = _long(spark, {1: [1, 5, 2, 8], 2: [3, 3, 4]})
    keys = ["record_id", "lead"]
    z, params = SG.zscore(df, keys)
    back = SG.inverse_zscore(z, params, keys).collect()
    assert all(abs(r.v_back - r.v) < 1e-12 for r in back)
    zp = SG.zscore_packed(SG.pack(df, keys)).collect()
    zl = {(r.record_id, r.t): r.z for r in z.collect()}
    for r in zp:
        for t, val in enumerate(r.z):
            assert abs(val - zl[(r.record_id, t)]) < 1e-12


def test_patches_golden_and_too_short(spark):
    df = _long(spark, {1: [1, 2, 3, 4, 5, 6], 2: [1]})
    packed = SG.pack(df.drop("lead"), ["record_id"])
    got = {r.record_id: r.patches for r in SG.patches_packed(packed, 4, 2).collect()}
    assert got[1] == [[1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 6, 6]]
    assert got[2] == []  # T + S < P: no patches


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.integers(1, 9), st.integers(1, 6))
def test_patches_long_equals_packed(spark, vals, p, s):
    df = _long(spark, {1: vals}).drop("lead")
    packed = SG.pack(df, ["record_id"])
    expect = SG.patches_packed(packed, p, s).collect()[0].patches
    long = SG.patches_long(df, ["record_id"], p, s).collect()
    rebuilt = {}
    for r in long:
        rebuilt.setdefault(r.patch_id, {})[r.offset] = r.v
    got = [[rebuilt[k][o] for o in range(p)] for k in sorted(rebuilt)]
    assert got == expect
    n = len(vals)
    assert len(expect) == (0 if n + s < p else (n + s - p) // s + 1)


def _brute_lags(x, k=5):
    n = len(x)
    c = [sum(x[t] * x[(t + tau) % n] for t in range(n)) for tau in range(n)]
    return sorted(range(n), key=lambda tau: (-c[tau], tau))[:k]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=25))
def test_fft_lags_equal_brute_force_any_length(spark, vals):
    df = spark.createDataFrame([(1, [float(v) for v in vals])], "record_id long, v array<double>")
    got = SG.autocorr_top_lags(df).collect()[0].lags
    assert got == _brute_lags(vals)


def test_mirrored_lags_smaller_first(spark):
    x = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]  # all nonzero lags tie
    df = spark.createDataFrame([(1, x)], "record_id long, v array<double>")
    assert SG.autocorr_top_lags(df).collect()[0].lags == [0, 1, 2, 3, 4]


def test_combine_leads_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = {lead: rng.integers(-9, 9, size=7) for lead in ("a", "b")}
    w = {("a", 0): 1, ("a", 1): -2, ("a", 2): 3, ("b", 0): 2, ("b", 1): 0, ("b", 2): -1}
    data = [(1, lead, t, int(v)) for lead, vals in x.items() for t, v in enumerate(vals)]
    df = spark.createDataFrame(data, "record_id long, lead string, t long, v long")
    weights = spark.createDataFrame([(l, k, v) for (l, k), v in w.items()], "lead string, k int, w long")
    got = {r.t: r.y for r in SG.combine_leads(df, weights).collect()}
    n = 7
    expect = {t: sum(w[(l, k)] * x[l][(t + k - 1) % n] for l in x for k in range(3)) for t in range(n)}
    assert got == expect


def test_pack_rejects_gaps(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0)], "record_id long, t long, v double")
    try:
        SG.pack(df, ["record_id"]).collect()
        raise AssertionError("expected a failure")
    except Exception as e:  # noqa: BLE001
        assert "gaps" in str(e)


def test_text_formatting(spark):
    df = spark.createDataFrame([(0.03125, [0, 1, 2])], "x double, l array<int>")
    r = df.select(fixed4("x").alias("f"), int_list_text("l").alias("s")).collect()[0]
    assert r.f == "0.0312"  # the exact binary value is a tie: to the even digit
    assert r.s == "[0, 1, 2]"


def test_sorted_lower_median_equals_percentile_disc_on_a_split_series(spark):
    import random

    rnd = random.Random(11)
    series = {1: [rnd.randint(0, 50) for _ in range(301)], 2: [rnd.randint(0, 5) for _ in range(40)], 3: [7.0]}
    df = _long(spark, series)
    got = {r.record_id: r.median_v for r in SG.lower_median(df, ["record_id"]).collect()}
    expect = {k: float(sorted(v)[(len(v) + 1) // 2 - 1]) for k, v in series.items()}
    assert got == expect
    native = df.groupBy("record_id").agg(F.expr("percentile_disc(0.5) within group (order by v)").alias("m"))
    assert got == {r.record_id: r.m for r in native.collect()}
    disc = {r.record_id: r.median_v for r in SG.series_stats(df, ["record_id"]).collect()}
    assert disc == expect


def test_pack_length_bound(spark):
    df = _long(spark, {1: list(range(10))}).drop("lead")
    assert SG.pack(df, ["record_id"], max_len=10).count() == 1
    try:
        SG.pack(df, ["record_id"], max_len=9)
        raise AssertionError("expected a failure")
    except ValueError as e:
        assert "max_len" in str(e)


def test_lags_of_series_above_the_packing_bound(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, t, float(rnd.randint(-40, 90))) for i, n in enumerate([1, 2, 5, 16, 17, 63, 64, 200]) for t in range(n)]
    rows += [(None, t, float(t % 7)) for t in range(49)] + [(9, t, 0.0) for t in range(30)] + [(10, t, float("nan") if t == 3 else 1.0) for t in range(30)]
    df = spark.createDataFrame(rows, "record_id long, t long, v double")
    want = {r.record_id: r.lags for r in SG.autocorr_top_lags(SG.pack(df, ["record_id"])).collect()}
    for cells in (1, 16, 100, 1 << 20):
        dealt = SG.autocorr_top_lags_distributed(df, ["record_id"], cells=cells).collect()
        assert {r.record_id: r.lags for r in dealt} == want and len(dealt) == len(want)
    assert {r.record_id: r.lags for r in SG.top_lags_long(df, ["record_id"], max_len=20, cells=64).collect()} == want
    assert want[10] is None and want[9] == [0, 1, 2, 3, 4]


def test_features_of_series_above_the_packing_bound(spark, monkeypatch):
    from wavequery.plans.features import series_features

    df = _long(spark, {1: [3, 1, 4, 1, 5, 9, 2, 6], 2: [2, 7]})
    lead = df.first()["lead"]
    weights = spark.createDataFrame([(lead, k, 1) for k in range(3)], "lead string, k int, w bigint")
    whole = {(r.record_id, p, o): x for r in series_features(df, weights, 4, 2).patches.collect() for p, row in enumerate(r.patches) for o, x in enumerate(row)}
    monkeypatch.setattr(SG, "MAX_FFT_SAMPLES", 4)
    feats = series_features(df, weights, 4, 2)
    assert {(r.record_id, r.patch_id, r.offset): r.v for r in feats.patches_long.collect()} == whole
    assert {r.record_id for r in feats.stats.collect()} == {1, 2}


def test_first_differences_sum_to_trend(spark):
    df = _long(spark, {1: [3, 1, 4, 1, 5]})
    d = SG.first_differences(df, ["record_id"]).orderBy("t").collect()
    assert d[0].dv is None and [r.dv for r in d[1:]] == [-2.0, 3.0, -3.0, 4.0]
    trend = SG.series_stats(df, ["record_id"]).collect()[0].trend
    assert sum(r.dv for r in d[1:]) == trend == 2.0


def test_differences_do_not_depend_on_the_chunk(spark):
    rows = [(r, t * 3 - 10, float(t * t + r)) for r in (1, 2) for t in range(17)] + [(None, t, 2.0 * t) for t in range(5)]
    df = spark.createDataFrame(rows, "record_id long, t long, v double")
    want = {}
    for r, t, v in rows:
        before = max((x for x in rows if x[0] == r and x[1] < t), key=lambda x: x[1], default=None)
        want[(r, t)] = None if before is None else v - before[2]
    for chunk in (1, 2, 7, 1 << 16):
        got = {(x.record_id, x.t): x.dv for x in SG.first_differences(df, ["record_id"], chunk=chunk).collect()}
        assert got == want


def test_affine_forward_and_back_and_unpack(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0], 3.0, 2.0), (2, [7.0], 1.0, 0.0)], "record_id long, v array<double>, mean double, std double")
    long = SG.unpack(df.select("record_id", "v"), ["record_id"]).join(df.select("record_id", "mean", "std"), "record_id")
    x = long.withColumn("z", SG.affine("v", "mean", "std")).withColumn("back", SG.affine_inverse("z", "mean", "std"))
    got = {(r.record_id, r.t): (r.v, r.z, r.back) for r in x.collect()}
    assert got == {(1, 0): (1.0, -1.0, 1.0), (1, 1): (5.0, 1.0, 5.0), (2, 0): (7.0, None, None)}


def test_statistics_of_null_series_null_samples_and_nan(spark):
    rows = [(None, t, v) for t, v in enumerate([4.0, 1.0, 3.0, 2.0])] + [(1, 0, None), (1, 1, 5.0)] + [(2, 0, 1.0), (2, 1, float("nan"))]
    rows += [(3, 0, None)]
    df = spark.createDataFrame(rows, "record_id long, t long, v double")
    got = {r.record_id: (r.min_v, r.max_v, r.median_v, r.n) for r in SG.series_stats(df, ["record_id"]).collect()}
    assert got[None] == (1.0, 4.0, 2.0, 4) and got[1] == (5.0, 5.0, 5.0, 2) and got[3] == (None, None, None, 1)
    assert all(x != x for x in got[2][:3])


def test_selection_is_exact_with_coarse_sketches_ties_and_nulls(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    series = {
        1: [rnd.gauss(0, 1) for _ in range(6000)], 2: [rnd.randint(0, 3) for _ in range(900)], 3: [5.0] * 70, 4: [10.0**e for e in range(-300, 300)],
        5: [2.0], 6: [1.0, 2.0], 7: list(range(1000, 0, -1)), None: [rnd.random() for _ in range(333)], 9: [float("inf"), 1.0, -float("inf"), 0.0, -0.0],
    }
    rows = [(k, t, float(x)) for k, v in series.items() for t, x in enumerate(v)] + [(1, 99_999, None), (10, 0, None)]
    df = spark.createDataFrame(rows, "record_id long, t long, v double").repartition(5)
    want = {k: float(sorted(v)[(len(v) + 1) // 2 - 1]) for k, v in series.items()}
    for middle, evenly, accuracy in ((SG._MIDDLE, SG._EVENLY, SG._ACCURACY), ([0.0, 1.0], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], 40)):
        for name, value in (("_MIDDLE", middle), ("_EVENLY", evenly), ("_ACCURACY", accuracy)):
            monkeypatch.setattr(SG, name, value)
        assert {r.record_id: r.median_v for r in SG.lower_median(df, ["record_id"]).collect()} == want
    stats = {r.record_id: r.median_v for r in SG.series_stats(df, ["record_id"]).collect()}
    assert stats == want | {10: None}
    assert SG.lower_median(df.where("t < 0"), ["record_id"]).count() == 0


def test_distributed_transform_refuses_gaps_and_repeated_times(spark):
    for times in ([0, 1, 3, 4], [0, 1, 1, 3], [1, 2, 3, 4]):
        df = spark.createDataFrame([(1, t, 1.0) for t in times], "record_id long, t long, v double")
        try:
            SG.autocorr_top_lags_distributed(df, ["record_id"], cells=4).collect()
            raise AssertionError("expected a failure")
        except Exception as e:  # noqa: BLE001
            assert "gaps" in str(e)


def test_distributed_transform_holds_few_numbers_and_grows_in_proportion():
    for n in (1000, 2000, 4000, 1 << 20, (1 << 24) + 1):
        n1, n2, c, r = SG._factors(n, 1 << 12)
        assert n1 * n2 >= 2 * n and n1 * n2 < 8 * n and n1 * c <= max(1 << 12, n1) and r * n2 <= max(1 << 12, n2)
        assert n2 // c + n1 // r <= 2 * (8 * n // (1 << 12) + 1) + 2 * max(n1, n2) // max(1, (1 << 12) // max(n1, n2))
