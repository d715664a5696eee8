import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavequery.operators import runs as R
from wavequery.operators import sequences as SQ
from wavequery.operators import vectors as V


def test_zero_vector_normalises_to_null_and_cosine_null(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [3.0, 4.0])], "batch_id long, idx int, embedding array<double>")
    n = {r.idx: r for r in V.normalize_vectors(df).collect()}
    assert n[0].unit == [None, None]
    assert n[1].unit == [0.6, 0.8] and n[1].norm == 5.0
    sims = {(r.i, r.j): r.sim for r in V.batch_cosine(df).collect()}
    assert sims[(0, 1)] is None and abs(sims[(1, 1)] - 1.0) < 1e-12


def test_prototype_blend_matches_numpy(spark):
    rng = np.random.default_rng(7)
    q = rng.normal(size=(3, 8))
    k = rng.normal(size=(4, 8))
    df = spark.createDataFrame([(i, q[i].tolist()) for i in range(3)], "vec_id long, embedding array<double>")
    protos = spark.createDataFrame([(j, k[j].tolist()) for j in range(4)], "label long, proto array<double>")
    out = {r.vec_id: r for r in V.prototype_blend(df, protos, n_heads=2).collect()}
    for i in range(3):
        blend = []
        for h in range(2):
            sl = slice(4 * h, 4 * h + 4)
            s = k[:, sl] @ q[i, sl] / math.sqrt(4)
            w = np.exp(s - s.max())
            w /= w.sum()
            got_w = out[i].weights[h]
            assert np.allclose(got_w, w) and abs(sum(got_w) - 1) < 1e-12
            blend += (w @ k[:, sl]).tolist()
        assert np.allclose(out[i].blend, blend)
    with pytest.raises(ValueError):
        V.prototype_blend(df, protos, n_heads=2, max_prototypes=3)


def test_similarity_mse_and_mean_of_batches(spark):
    sim = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 0.5), (1, 0, 0, 1.0)], "batch_id long, i int, j int, sim double")
    score = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 0.0), (1, 0, 0, 0.0)], "batch_id long, i int, j int, score double")
    per = V.similarity_mse(sim, score)
    got = {r.batch_id: r.sim_mse for r in per.collect()}
    assert got == {0: 0.125, 1: 1.0}
    assert V.mean_of_batches(per, "sim_mse").collect()[0].mean_sim_mse == 0.5625  # unweighted by batch size
    rolled = {(r.batch_id, r.level): (r.n_cells, r.sim_mse) for r in V.with_mean_of_batches(per, "sim_mse", "n_cells").collect()}
    assert rolled == {(0, 0): (2, 0.125), (1, 0): (1, 1.0), (None, 1): (2, 0.5625)}
    assert spark.range(1).select(V.combined_loss(F.lit(2.0), F.lit(4.0)).alias("x")).collect()[0].x == 3.0


def test_sequence_truncation_padding_and_labels(spark):
    df = spark.createDataFrame(
        [(0, 0, [1] + [9] * 600, [1, 7], [1, 5, 2]), (0, 1, [1, 9], [1, 7], [1, 5, 2])],
        "batch_id long, turn long, prefix array<int>, suffix array<int>, answer array<int>",
    )
    a = SQ.assemble(df, "prefix", "suffix", "answer", 3)
    c = {r.turn: r for r in SQ.collate(a).collect()}
    assert c[0].truncated and len(c[0].input_ids) == 512 + 3 + 1 + 2
    assert c[0].labels[-2:] == [5, 2] and c[0].labels[:-2] == [-100] * (512 + 3 + 1)
    assert not c[1].truncated and c[1].seq_len == 2 + 3 + 1 + 2
    assert c[1].max_len == c[0].seq_len
    pad = c[1].max_len - c[1].seq_len
    assert c[1].input_ids_padded[:pad] == [0] * pad and c[1].attention_mask == [0] * pad + [1] * c[1].seq_len
    assert c[1].labels_padded[:pad] == [-100] * pad
    n = spark.createDataFrame([([-100, -100, 5, 2],)], "l array<int>").select(SQ.target_count("l").alias("n")).collect()[0].n
    assert n == 2


def _early_py(losses, patience, delta=0.0):
    """Plain restatement of the stopping rule (NaN never improves)."""
    best, counter, stop, out = None, 0, False, []
    for loss in losses:
        valid = not math.isnan(loss)
        score = -loss
        if best is None and valid:
            best = score
            improved = True
        elif valid and not (score < best + delta):
            best, counter, improved = score, 0, True
        else:
            improved = False
            if best is not None:
                counter += 1
        stop = stop or counter >= patience
        out.append((improved, counter, stop))
    return out


def _metrics(spark, losses):
    return spark.createDataFrame([("r", e, float(v)) for e, v in enumerate(losses)], "run_id string, epoch long, val_loss double")


def test_early_stopping_golden(spark):
    df = _metrics(spark, [3, 2, 2, 4, 4])
    got = [(r.counter, r.stop) for r in R.early_stopping(df, patience=2).orderBy("epoch").collect()]
    assert got == [(0, False), (0, False), (0, False), (1, False), (2, True)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=15), st.sampled_from([0.0, 0.5, -0.5]))
def test_fold_matches_restatement_and_window_at_zero_delta(spark, losses, delta):
    df = _metrics(spark, losses)
    fold = [(r.improved, r.counter, r.stop) for r in R.early_stopping_fold(df, patience=2, delta=delta).orderBy("epoch").collect()]
    assert fold == _early_py([float(x) for x in losses], 2, delta)
    if delta == 0.0:
        win = [(r.improved, r.counter, r.stop) for r in R.early_stopping(df, patience=2).orderBy("epoch").collect()]
        assert win == fold


def test_nan_loss_is_not_an_improvement(spark):
    df = _metrics(spark, [3.0, float("nan"), 2.0])
    got = [(r.improved, r.counter) for r in R.early_stopping(df, patience=5).orderBy("epoch").collect()]
    assert got == [(True, 0), (False, 1), (True, 0)]
    fold = [(r.improved, r.counter) for r in R.early_stopping_fold(df, patience=5).orderBy("epoch").collect()]
    assert fold == got


def test_flatten_matrix(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "m array<array<double>>")
    assert V.flatten_matrix(df, "m").collect()[0].vec == [1.0, 2.0, 3.0, 4.0]


def test_fold_is_linear_in_the_history(spark):
    import time

    def seconds(n):
        df = spark.range(n).selectExpr("1 as run_id", "id as epoch", "cast(id % 7 as double) as val_loss")
        t0 = time.perf_counter()
        assert R.early_stopping_fold(df, delta=0.5).where("stop").count() > 0
        return time.perf_counter() - t0

    seconds(1000)
    assert seconds(200_000) < 20


def test_heads_must_divide_the_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], "vec_id long, embedding array<double>, label int")
    protos = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "label int, proto array<double>")
    with pytest.raises(ValueError, match="divide"):
        V.prototype_blend(df, protos, n_heads=2)


def test_no_aggregate_inside_an_element_loop(spark):
    import time

    from wavequery.operators import signals as SG

    for make in (lambda d: V.normalize_vectors(d, "v", "u"), lambda d: SG.zscore_packed(d)):
        t = []
        for n in (2000, 8000):
            d = spark.range(20).selectExpr("id", f"transform(sequence(1, {n}), i -> double(i)) as v")
            make(d).write.format("noop").mode("overwrite").save()
            t0 = time.perf_counter()
            make(d).write.format("noop").mode("overwrite").save()
            t.append(time.perf_counter() - t0)
        assert t[1] < 8 * t[0] + 1


def test_packed_statistics_propagate_nan(spark):
    import math

    from wavequery.operators import signals as SG

    d = spark.createDataFrame([([1.0, float("nan"), 3.0],)], "v array<double>")
    row = SG.series_stats_packed(d).collect()[0]
    assert all(math.isnan(row[c]) for c in ("min_v", "max_v", "median_v", "trend"))
    assert SG.autocorr_top_lags(d).collect()[0].lags is None


def test_prototype_blocks_give_the_one_block_result(spark):
    rng = np.random.default_rng(3)
    q, k, v = rng.normal(size=(5, 4)), rng.normal(size=(7, 4)) * 9, rng.normal(size=(7, 6))
    df = spark.createDataFrame([(i, q[i].tolist()) for i in range(5)] + [(9, None)], "vec_id long, embedding array<double>")
    protos = spark.createDataFrame([(j, k[j].tolist(), v[j].tolist()) for j in range(7)], "label long, proto array<double>, val array<double>")
    one = {r.vec_id: r for r in V.prototype_blend(df, protos, n_heads=2, value_col="val").collect()}
    many = {r.vec_id: r for r in V.prototype_blend(df, protos, n_heads=2, value_col="val", block_bytes=160).collect()}
    assert one[9].blend is None and many[9].weights is None
    for i in range(5):
        s = np.stack([k[:, 2 * h : 2 * h + 2] @ q[i, 2 * h : 2 * h + 2] / math.sqrt(2) for h in range(2)])
        w = np.exp(s - s.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        want = np.concatenate([w[h] @ v[:, 3 * h : 3 * h + 3] for h in range(2)])
        for got in (one[i], many[i]):
            assert np.allclose(got.blend, want) and np.allclose(got.weights, w) and got.proto_keys == list(range(7))


def test_prototype_blend_without_prototypes_is_null(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    protos = spark.createDataFrame([], "label long, proto array<double>")
    row = V.prototype_blend(df, protos, n_heads=2).collect()[0]
    assert row.blend is None and row.weights is None and row.proto_keys == []


def test_row_vectors_give_the_cell_form_error(spark):
    rng = np.random.default_rng(5)
    vecs = [(b, i, rng.normal(size=3).tolist()) for b in range(2) for i in range(4)] + [(1, 4, [0.0] * 3)]
    df = spark.createDataFrame(vecs, "batch_id long, idx int, embedding array<double>")
    n = {0: 4, 1: 5}
    rows = [(b, i, rng.uniform(size=n[b]).tolist()) for b, i, _ in vecs]
    scores = spark.createDataFrame(rows, "batch_id long, i int, scores array<double>")
    cells = scores.select("batch_id", "i", F.posexplode("scores").alias("j", "score"))
    want = {r.batch_id: (r.n_cells, r.sim_mse) for r in V.similarity_mse(V.batch_cosine(df), cells).collect()}
    got = {r.batch_id: (r.n_cells, r.sim_mse) for r in V.similarity_mse_rows(V.cosine_rows(df), scores).collect()}
    assert want.keys() == got.keys()
    for b in want:
        assert want[b][0] == got[b][0] and math.isclose(want[b][1], got[b][1])


def test_gram_blocks_of_any_width_give_the_same_similarities(spark):
    rng = np.random.default_rng(8)
    vecs = [(b, i, rng.normal(size=11).tolist()) for b in (0, 1, 2) for i in range(5)]
    vecs += [(1, 5, [0.0] * 11), (1, 6, None), (1, 7, [1.0] * 4), (1, 8, []), (2, 5, [None] + [1.0] * 10), (None, 0, [2.0, 1.0]), (None, 3, [1.0, 0.0])]
    df = spark.createDataFrame(vecs, "batch_id long, idx int, embedding array<double>").repartition(3)
    held = {(b, i): v for b, i, v in vecs}

    def sim(v, w):
        if v is None or w is None or len(v) != len(w) or None in v or None in w or not any(v) or not any(w):
            return None
        return float(np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w)))

    for width in (1, 3, 4, 11, 4096):
        got = V.cosine_rows(df, width=width).collect()
        assert {(r.batch_id, r.i) for r in got} == set(held)
        for r in got:
            assert r.js == sorted(i for b, i in held if b == r.batch_id)
            for j, s in zip(r.js, r.sims):
                want = sim(held[r.batch_id, r.i], held[r.batch_id, j])
                assert (s is None) == (want is None) and (s is None or math.isclose(s, want, abs_tol=1e-12))
    assert V.cosine_rows(df.where("idx > 99")).count() == 0


def test_similarities_of_small_batches_leave_together(monkeypatch):
    rng = np.random.default_rng(2)
    n, x = 60, rng.normal(size=(60, 3))
    stream = pa.record_batch({
        "batch_id": pa.array([k // 2 if k > 1 else None for k in range(n)], pa.int64()), "_block": pa.array([0] * n, pa.int32()), "i": pa.array([k % 2 for k in range(n)], pa.int32()),
        "_x": pa.array(x.tolist(), pa.list_(pa.float64())), "_n": pa.array([3] * n, pa.int32()),
    })
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for cells, pieces in ((1 << 20, 1), (8, 15), (1, 30)):
        monkeypatch.setattr(V, "CELLS", cells)
        got = list(V._gram("batch_id")(iter([stream.slice(0, 7), stream.slice(7)])))
        assert len(got) == pieces
        rows = pa.Table.from_batches(got).to_pylist()
        assert [(r["batch_id"], r["i"], r["js"]) for r in rows] == [(k // 2 if k > 1 else None, k % 2, [0, 1]) for k in range(n)]
        assert np.allclose([r["sims"] for r in rows], [unit[k] @ unit[k // 2 * 2 : k // 2 * 2 + 2].T for k in range(n)])


def test_fifty_prototype_blocks_give_the_one_block_result_and_write_vectors_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    q, k = rng.normal(size=(40, 4)) * 20, rng.normal(size=(50, 4)) * 20
    df = spark.createDataFrame([(i, q[i].tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    protos = spark.createDataFrame([(j, k[j].tolist()) for j in range(50)], "label long, proto array<double>")
    names = []
    write = V.written
    monkeypatch.setattr(V, "written", lambda d, name: (names.append(name), write(d, name))[1])
    one = {r.vec_id: r for r in V.prototype_blend(df, protos, n_heads=2).collect()}
    assert names == []
    many = {r.vec_id: r for r in V.prototype_blend(df, protos, n_heads=2, block_bytes=64).collect()}
    assert names.count("vectors") == 1 and names.count("states") == 50
    for i in range(40):
        assert np.allclose(one[i].blend, many[i].blend) and np.allclose(one[i].weights, many[i].weights) and many[i].proto_keys == list(range(50))


def test_chunks_of_a_run_compose_to_the_fold(spark):
    import random

    rng = random.Random(9)
    runs = {None: 40, "hot": 600, "short": 1, "down": 90, "up": 90, "ties": 80, "gaps": 100, "nothing": 12}
    rows = []
    for name, n in runs.items():
        for e in range(n):
            loss = {"down": 100.0 - e, "up": float(e), "ties": float(rng.randrange(3)), "nothing": None}.get(name, rng.choice([rng.random() * 5, rng.random() * 5 / (1 + e / 40)]))
            if name == "gaps" and (e < 7 or rng.random() < 0.3):
                loss = rng.choice([None, float("nan")])
            rows.append((name, e * 2, loss))
    df = spark.createDataFrame(rows, "run_id string, epoch long, val_loss double").repartition(6)
    fields = ("run_id", "epoch", "improved", "best_loss", "counter", "stop")
    key = lambda r: (r.run_id or "", r.epoch)
    for delta, patience, chunk in ((0.0, 5, 16), (0.3, 5, 1), (0.3, 9, 7), (1.0, 30, 64), (0.1, 0, 16), (0.0, 3, 1 << 16)):
        want = [tuple(r[f] for f in fields) for r in sorted(R.early_stopping_fold(df, patience=patience, delta=delta).collect(), key=key)]
        got = [tuple(r[f] for f in fields) for r in sorted(R.early_stopping_chunked(df, patience=patience, delta=delta, chunk=chunk).collect(), key=key)]
        assert got == want
    with pytest.raises(ValueError):
        R.early_stopping_chunked(df, delta=-0.1)
    assert R.early_stopping_chunked(df.where("epoch < 0")).count() == 0


def test_a_hot_run_is_dealt_over_many_tasks(spark):
    df = spark.createDataFrame([("hot", e, float(e % 17)) for e in range(4000)], "run_id string, epoch long, val_loss double")
    out = R.early_stopping_chunked(df, chunk=100, delta=0.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    spread = [r[0] for r in df.selectExpr("pmod(hash(run_id, epoch div 100), 8)").distinct().collect()]
    assert len(spread) == 8 and out.count() == 4000
