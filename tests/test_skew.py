"""Hot keys: a group holding a third (or all) of the rows is split over balanced partitions."""

from pyspark.sql import functions as F

from wavequery.operators import ordering as O


def _partition_sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_hot_question_is_split_by_the_numbering(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"q{i % 50}", i, ["a"]) for i in range(6000)]
    qa = spark.createDataFrame(rows, "seq long, question string, record_id long, answer array<string>")
    numbered = O.with_positions(qa, O.grouped_shuffle_order(42, "question", "seq"), num_partitions=8)
    hot = numbered.df.where("question = 'hot'")
    assert hot.select(F.spark_partition_id()).distinct().count() >= 2  # the hot group spans partitions
    sizes = _partition_sizes(numbered.df)
    assert max(sizes) <= 2 * (6000 / 8)  # balanced: no partition near the hot group's 2000 rows alone
    assert sorted(r.pos for r in numbered.df.collect()) == list(range(6000))


def test_single_series_is_spread_for_point_adjustment(spark):
    df = spark.createDataFrame([(7, t, t % 5 != 0, t % 7 == 0) for t in range(4000)], "series_id long, t long, gt boolean, pred boolean")
    df = df.select("series_id", "t", F.col("gt").cast("int").alias("gt"), F.col("pred").cast("int").alias("pred"))
    sizes = _partition_sizes(O.with_positions(df, ["series_id", "t"], num_partitions=8).df)
    assert len(sizes) >= 6 and max(sizes) <= 2 * (4000 / 8)


def test_empty_inputs(spark):
    from wavequery.operators import evaluate as EV
    from wavequery.plans.training import training_batches

    qa = spark.createDataFrame([], "seq long, question string, record_id long, answer array<string>")
    batched, pairs = training_batches(qa, batch_size=4)
    assert batched.count() == 0 and pairs.count() == 0
    lab = spark.createDataFrame([], "series_id long, t long, gt int, pred int")
    assert EV.point_adjust(lab, num_partitions=3).count() == 0
    assert O.series_index(spark.createDataFrame([], "s long, ts long"), ["s"], ["ts"]).count() == 0


def _pairs(numbered):
    return sorted((r.pos, r.seq) for r in numbered.df.select("pos", "seq").collect())


def test_seeded_positions_equal_the_sorted_order_for_any_partition_count(spark):
    rows = [(i, None if i % 97 == 0 else "hot" if i % 3 == 0 else f"q{i % 50}" if i % 2 else f"own{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, question string")
    named = df.where("question is not null")
    want = _pairs(O.with_positions(named, O.grouped_shuffle_order(42, "question", "seq"), num_partitions=5))
    for n in (1, 3, 16):
        assert _pairs(O.seeded_positions(named, 42, "seq", "question", num_partitions=n)) == want
    want = _pairs(O.with_positions(df, O.global_shuffle_order(42, "seq"), num_partitions=5))
    for n in (1, 7):
        assert _pairs(O.seeded_positions(df, 42, "seq", num_partitions=n)) == want
    with_nulls = _pairs(O.seeded_positions(df, 42, "seq", "question", num_partitions=4))
    assert with_nulls == _pairs(O.seeded_positions(df, 42, "seq", "question", num_partitions=11))
    nulls = {s for s, q in rows if q is None}
    assert {s for p, s in with_nulls if p < len(nulls)} == nulls and [p for p, _ in with_nulls] == list(range(3000))


def test_seeded_positions_split_a_hot_group_evenly_and_shuffle_rows_once(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"q{i % 5}") for i in range(8000)], "seq long, question string")
    numbered = O.seeded_positions(df, 42, "seq", "question", num_partitions=8)
    assert numbered.total == 8000
    plan = numbered.df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan and "SinglePartition" not in plan  # rows are read as written
    key = F.conv(F.substring(O.seeded_key(42, "question", "seq"), 1, 8), 16, 10).cast("long")
    sizes = [r["n"] for r in df.where("question = 'hot'").groupBy((key * 8 / F.lit(1 << 32)).cast("int")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * (8000 * 2 / 3 / 8)
    assert O.seeded_positions(df.where("seq < 0"), 42, "seq", "question").df.count() == 0


def test_series_index_keeps_the_global_position(spark):
    rows = [(s, t, t * 10) for s, n in ((None, 5), (1, 40), (2, 3)) for t in range(n)]
    df = spark.createDataFrame(rows, "s long, u long, x long").repartition(4)
    got = O.series_index(df, ["s"], ["u"], length="n", num_partitions=6, position="place").collect()
    assert sorted((r.place, r.t, r.n) for r in got) == [(i, t, n) for i, (t, n) in enumerate((t, n) for n in (5, 40, 3) for t in range(n))]
    assert all(r.t == r.u and r.x == 10 * r.u for r in got)
