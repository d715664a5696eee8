"""Plan checks: built-in operators stay in the JVM; scans are pruned; no single-partition exchange."""

import pytest

import __spark_entry__ as E
from wavequery.plans import catalog

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
# queries whose operator is Python by design (FFT lags, dense products, sequential fold)
ALLOWED_PYTHON = {"autocorr_top_lags", "prompt_text", "prototype_blend", "early_stopping_delta", "prototype_values", "combined_prompt_text", "batch_cosine", "batch_similarity_mse", "early_stopping_chunked"}
# queries that run a stream or a sink before returning (their result is a scan of written files)
MATERIALISED = {"stream_early_stop", "stream_accuracy", "stream_accuracy_dedup", "annotation_roundtrip"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(catalog.queries()) - ALLOWED_PYTHON - MATERIALISED))
def test_builtin_queries_have_no_python_nodes(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    assert not any(node in plan for node in PYTHON_NODES), plan


def test_flagship_scans_are_pruned_and_filters_pushed(spark):
    df = E.entry(spark)
    text = df._jdf.queryExecution().executedPlan().toString()
    formatted = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    explained = df._jdf.queryExecution().explainString(formatted)
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in explained
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in explained
    assert "SinglePartition" not in text


@pytest.mark.parametrize("key", ["batch_assignment", "pair_scores", "grouped_shuffle_pos", "point_adjust", "first_differences", "series_stats", "combined_patches", "sample_files", "annotation_files"])
def test_ordering_queries_avoid_single_partition(spark, key):
    assert "SinglePartition" not in _plan(E.queries()[key](spark, SF))
