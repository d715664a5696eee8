from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavequery.functions import dice
from wavequery.operators import ordering as O
from wavequery.operators import qa as Q
from wavequery.plans.training import order_examples, prepare, training_batches


def test_dice_uses_set_size_over_list_sizes(spark):
    df = spark.createDataFrame([(["a", "a"], ["a"]), ([], []), (["a", "b"], ["b", "c"])], "x array<string>, y array<string>")
    got = [r.d for r in df.select(dice("x", "y").alias("d")).collect()]
    assert abs(got[0] - 2 / 3) < 1e-12
    assert got[1] is None
    assert got[2] == 0.5


def _qa(spark, data):
    return spark.createDataFrame(data, "seq long, question string, record_id long, answer array<string>")


def test_lookup_last_wins_and_diagonal_override(spark):
    qa = _qa(spark, [(0, "q", 7, ["yes"]), (1, "q", 7, ["no"])])
    lk = Q.lookup_last_wins(qa).collect()
    assert [(r.record_id, r.answer, r.n_rows) for r in lk] == [(7, ["no"], 2)]
    batched, pairs = training_batches(qa, batch_size=2, mode="file")
    cells = {(r.i, r.j): r.score for r in pairs.collect()}
    order = {r.seq: r.idx for r in batched.collect()}
    first = order[0]
    assert cells[(first, first)] == 0.0  # the later [no] overrides the diagonal 1 for the [yes] row


def test_diagonal_miss_and_asymmetry(spark):
    lookup = spark.createDataFrame([("q1", 1, ["a"])], "question string, record_id long, answer array<string>")
    batched = spark.createDataFrame(
        [(0, 0, "q1", 1, ["a"]), (0, 1, "q2", 2, ["a"])], "batch_id long, idx int, question string, record_id long, answer array<string>"
    )
    cells = {(r.i, r.j): (r.score, r.known) for r in Q.pair_scores(batched, lookup).collect()}
    assert cells[(1, 1)] == (1.0, False)  # record 2 missing from the lookup: diagonal stays 1
    assert cells[(0, 0)] == (1.0, True)
    assert cells[(1, 0)] == (0.0, False)  # row 1 probes with its own question q2 -> miss
    assert cells[(0, 1)] == (0.0, False)


def test_agreement_of_odd_answers_equals_the_cell_form(spark):
    batched = [
        (0, 0, "q", 1, ["a", "a", "b"]), (0, 1, "q", 2, []), (0, 2, "q", 3, None), (0, 3, "p", 1, ["b", None]), (0, 4, None, 4, ["a"]), (0, 5, "q", None, ["c"]),
        (1, 0, "p", 9, ["z"]), (1, 1, "p", 2, ["x", "y"]), (None, 0, "q", 1, ["a"]),
    ]
    lookup = [("q", 1, ["b", "a"]), ("q", 2, []), ("q", 3, ["a", None]), ("q", 4, None), ("p", 1, [None, "b", "b"]), ("p", 2, ["y"])]
    df = spark.createDataFrame(batched, "batch_id long, idx int, question string, record_id long, answer array<string>")
    lk = spark.createDataFrame(lookup, "question string, record_id long, answer array<string>")
    rows = Q.pair_score_rows(df, lk)
    assert "array_intersect" not in rows._jdf.queryExecution().optimizedPlan().toString()  # interpreted for every cell
    held = {(q, r): a for q, r, a in lookup}

    def score(i, gt, j, la):
        if la is None:
            return float(i == j)
        return None if gt is None or not gt + la else 2.0 * len(set(gt) & set(la)) / (len(gt) + len(la))

    want = {}
    for b, i, q, _, gt in batched:
        if b is not None and q is not None:
            las = [(j, held.get((q, r))) for c, j, _, r, _ in batched if c == b]
            want[b, i] = [score(i, gt, j, la) for j, la in las], [la is not None for _, la in las]
    got = rows.collect()
    assert {(r.batch_id, r.i): (r.scores, r.known) for r in got} == want and len(got) == len(want)


def test_drop_last_and_limit(spark):
    qa = _qa(spark, [(i, f"q{i % 3}", i, ["a"]) for i in range(70)])
    batched, pairs = training_batches(qa, batch_size=32, mode="grouped")
    assert batched.count() == 64
    assert batched.select("batch_id").distinct().count() == 2
    assert pairs.count() == 2 * 32 * 32
    assert order_examples(qa, "global", num_data=0).df.count() == 70  # limit 0 = all
    assert order_examples(qa, "global", num_data=10).df.count() == 10


def test_positions_match_single_partition_row_number(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    order = O.global_shuffle_order(42, "o_orderkey")
    expect = orders.select("o_orderkey", (F.row_number().over(Window.orderBy(*order)) - 1).alias("pos"))
    expected = {r.o_orderkey: r.pos for r in expect.collect()}
    for n in (1, 3, 8):
        got = O.with_positions(orders, order, num_partitions=n)
        assert got.total == len(expected)
        assert {r.o_orderkey: r.pos for r in got.df.collect()} == expected


def test_numbering_plan_has_no_single_partition_exchange(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    numbered = O.with_positions(orders, O.global_shuffle_order(42, "o_orderkey"))
    plan = numbered.df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1000)), min_size=1, max_size=40, unique_by=lambda x: x[1]))
def test_grouped_shuffle_is_permutation_with_contiguous_groups(spark, items):
    qa = _qa(spark, [(seq, f"q{g}", seq, ["a"]) for g, seq in items])
    got = sorted((r.pos, r.question, r.seq) for r in order_examples(qa, "grouped").df.collect())
    assert [p for p, _, _ in got] == list(range(len(items)))
    assert sorted(s for _, _, s in got) == sorted(s for _, s in items)
    seen, prev = set(), None
    for _, q, _ in got:
        if q != prev:
            assert q not in seen  # a group never reappears after another started
            seen.add(q)
            prev = q
    again = {r.seq: r.pos for r in order_examples(qa.repartition(3), "grouped").df.collect()}
    assert again == {s: p for p, _, s in got}  # independent of input partitioning


def test_score_matrix_and_batch_columns(spark):
    qa = _qa(spark, [(i, "q", i, ["a"] if i % 2 else ["a", "b"]) for i in range(4)])
    batched, pairs = training_batches(qa, batch_size=2, mode="file")
    m = Q.score_matrix(pairs).orderBy("batch_id").collect()
    assert len(m) == 2 and all(len(r.matrix) == 2 and all(len(row) == 2 for row in r.matrix) for r in m)
    from wavequery.plans.training import training_score_matrices

    m2 = training_score_matrices(qa, batch_size=2, mode="file").orderBy("batch_id").collect()
    assert [r.matrix for r in m2] == [r.matrix for r in m]
    cols = Q.batch_columns(batched, ["seq", "answer"]).orderBy("batch_id").collect()
    assert cols[0].seq == [0, 1] and cols[1].seq == [2, 3]


def test_prepare_builds_lookup_from_whole_input_before_limit(spark):
    qa = _qa(spark, [(i, "q", i, ["a"]) for i in range(10)])
    prep = prepare(qa, mode="file", num_data=3)
    assert prep.total == 3
    assert prep.lookup.count() == 10


def test_batch_hook_and_random_access(spark):
    qa = _qa(spark, [(i, "q", i, ["a"]) for i in range(6)])
    batched, _ = training_batches(qa, batch_size=3, mode="file")
    hooked = Q.collate_batches(batched, ["seq"], hook=lambda d: d.withColumn("n", F.size("seq")))
    assert sorted((r.batch_id, r.n) for r in hooked.collect()) == [(0, 3), (1, 3)]
    assert [r.seq for r in Q.example_at(batched, 4).collect()] == [4]


def test_series_index_distributed_equals_window_on_a_hot_series(spark):
    import random

    rnd = random.Random(3)
    rows_ = [(0 if rnd.random() < 0.6 else rnd.randint(1, 5), rnd.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows_, "sid long, ts long, eid long")
    from pyspark.sql import Window

    per = Window.partitionBy("sid")
    byw = df.withColumn("t", F.row_number().over(per.orderBy("ts", "eid")) - 1).withColumn("n", F.count("*").over(per))
    w = {(r.sid, r.eid): (r.t, r.n) for r in byw.collect()}
    d = O.series_index(df, ["sid"], ["ts", "eid"], length="n", num_partitions=6)
    assert {(r.sid, r.eid): (r.t, r.n) for r in d.collect()} == w
    nulls = spark.createDataFrame([(None, 2, 1), (None, 1, 2), (3, 1, 3)], "sid long, ts long, eid long")
    assert sorted((r.eid, r.t) for r in O.series_index(nulls, ["sid"], ["ts", "eid"]).collect()) == [(1, 1), (2, 0), (3, 0)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=4), st.lists(st.sampled_from("abc"), max_size=4))
def test_dice_is_symmetric(spark, a, b):
    df = spark.createDataFrame([(a, b)], "x array<string>, y array<string>")
    r = df.select(dice("x", "y").alias("xy"), dice("y", "x").alias("yx")).collect()[0]
    assert r.xy == r.yx
