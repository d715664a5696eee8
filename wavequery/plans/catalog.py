"""Query catalog: one Spark query per operator family and its DuckDB oracle.

Each query reads the driver tables through the stand-in views and runs over
whole tables. Outputs are flat: list-valued results are rendered as text with
a fixed separator, numeric arrays are returned in long form, floats that are
sums of inexact values are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.plans.oracle_views import with_views
from wavequery.schemas import ATTRIBUTE_TYPES, DETAIL_QUESTION_TYPES, QUESTION_TYPES
from wavequery.sources import standins as S
from wavequery.operators import evaluate as EV
from wavequery.session import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


# --------------------------------------------------------------------------- evaluation

_SCORED_SQL = """
scored as (
  select qa.*, string_split(regexp_replace(p.prediction, '^\\s+|\\s+$', '', 'g'), '.') as pred_list
  from qa join predictions p using (seq)),
judged as (
  select *, list_sort(list_distinct(pred_list)) = list_sort(list_distinct(answer)) as correct from scored)"""


def scored_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.mark_correct(EV.attach_predictions(S.qa(spark, sf_dir), S.predictions(spark, sf_dir)))


@register(
    "accuracy_by_question_type",
    with_views(
        ["qa", "predictions"],
        f"""with {_SCORED_SQL}
select question_type, cast(sum(case when correct then 1 else 0 end) as bigint) as correct,
       cast(count(*) as bigint) as total,
       cast(sum(case when correct then 1 else 0 end) as double) / count(*) * 100.0 as acc_pct
from judged group by question_type""",
    ),
)
def accuracy_by_question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the fixed list's members that no example has are added and filtered out again (FLT-4)
    return EV.accuracy_by(scored_examples(spark, sf_dir), "question_type", categories=QUESTION_TYPES)


@register(
    "accuracy_by_attribute_type",
    with_views(
        ["qa", "predictions"],
        f"""with {_SCORED_SQL},
dim(attribute_type) as (values {", ".join(f"('{a}')" for a in ATTRIBUTE_TYPES)}),
rows_ as (
  select attribute_type, case when correct then 1 else 0 end as c, 1 as n from judged
  union all select attribute_type, 0, 0 from dim)
select attribute_type, cast(sum(c) as bigint) as correct, cast(sum(n) as bigint) as total,
       case when sum(n) > 0 then cast(sum(c) as double) / sum(n) * 100.0 end as acc_pct
from rows_ group by attribute_type""",
    ),
)
def accuracy_by_attribute_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.accuracy_by(scored_examples(spark, sf_dir), "attribute_type", categories=ATTRIBUTE_TYPES, keep_empty=True)


@register(
    "accuracy_detail_sets",
    with_views(
        ["qa", "predictions"],
        f"""with {_SCORED_SQL},
rows_ as (
  select question_type, attribute_type, case when correct then 1 else 0 end as c from judged
  union all
  select q, a, null from (values {", ".join(f"('{q}')" for q in DETAIL_QUESTION_TYPES)}) as x(q),
    (values {", ".join(f"('{a}')" for a in ATTRIBUTE_TYPES)}) as y(a))
select question_type, attribute_type, cast(grouping(question_type, attribute_type) as integer) as level,
       cast(coalesce(sum(c), 0) as bigint) as correct, cast(count(c) as bigint) as total,
       case when count(c) > 0 then cast(sum(c) as double) / count(c) * 100.0 end as acc_pct
from rows_
group by grouping sets ((question_type, attribute_type), (question_type), (attribute_type), ())""",
    ),
)
def accuracy_detail_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.accuracy_detail(scored_examples(spark, sf_dir), first_values=DETAIL_QUESTION_TYPES, second_values=ATTRIBUTE_TYPES)


@register(
    "accuracy_by_label",
    with_views(
        ["qa", "predictions"],
        """with scored as (
  select question_type, string_split(regexp_replace(p.prediction, '^\\s+|\\s+$', '', 'g'), '.') as pred_list, list_slice(answer, 1, 2) as label
  from qa join predictions p using (seq)),
judged as (select question_type, list_sort(list_distinct(pred_list)) = list_sort(list_distinct(label)) as correct from scored)
select question_type, cast(sum(case when correct then 1 else 0 end) as bigint) as correct, count(*) as total,
       cast(sum(case when correct then 1 else 0 end) as double) / count(*) * 100.0 as acc_pct
from judged group by question_type""",
    ),
)
def accuracy_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: the report against another truth column (here: the first two codes of the answer)."""
    scored = EV.attach_predictions(S.qa(spark, sf_dir), S.predictions(spark, sf_dir)).withColumn("label", F.slice("answer", 1, 2))
    return EV.accuracy_by(EV.mark_correct(scored, truth="label"), "question_type")


@register(
    "elementwise_accuracy",
    with_views(
        ["binary_labels"],
        """select series_id, cast(grouping(series_id) as integer) as level,
       avg(case when pred = gt then 1.0 else 0.0 end)::double as accuracy, count(*) as n
from binary_labels group by rollup (series_id)""",
    ),
)
def elementwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.elementwise_accuracy(S.label_rows(spark, sf_dir), by="series_id")


@register(
    "point_adjust",
    with_views(
        ["binary_labels"],
        """with r as (
  select *, sum(1 - gt) over (partition by series_id order by t rows between unbounded preceding and current row) as run,
         t = min(t) over (partition by series_id) as first_row
  from binary_labels),
h as (select *, max(case when gt = 1 then pred end) over (partition by series_id, run) as hit from r)
select series_id, t, gt, pred,
       case when gt = 1 and hit = 1 and not first_row then 1 else pred end as adjusted
from h""",
    ),
)
def point_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.point_adjust(S.binary_labels(spark, sf_dir, position="place"), pos="place")


# --------------------------------------------------------------------------- preparation

_ORDER_GROUPED = "md5('42|' || question), question, md5('42|' || question || '|' || seq), seq"
_BATCHED_SQL = f"""
ordered as (select *, row_number() over (order by {_ORDER_GROUPED}) - 1 as pos from qa),
keep as (select (count(*) // 32) * 32 as n_keep from qa),
batched as (select ordered.*, pos // 32 as batch_id, cast(pos % 32 as integer) as idx from ordered, keep where pos < n_keep),
lookup as (select question, record_id, arg_max(answer, seq) as answer from qa group by question, record_id),
pairs as (
  select a.batch_id, a.idx as i, b.idx as j, a.answer as gt, l.answer as la
  from batched a join batched b on a.batch_id = b.batch_id
  left join lookup l on l.question = a.question and l.record_id = b.record_id),
scores as (
  select batch_id, i, j,
         case when la is not null
              then cast(len(list_distinct(list_filter(gt, lambda x: list_contains(la, x)))) * 2 as double) / (len(gt) + len(la))
              when i = j then 1.0::double else 0.0::double end as score,
         la is not null as known
  from pairs)"""


def _batched(spark: SparkSession, sf_dir: str, batch_size: int = 32):
    from wavequery.plans.training import training_batches

    return training_batches(S.qa(spark, sf_dir), batch_size=batch_size, mode="grouped", seed=42, drop_last=True)


@register(
    "answer_text",
    with_views(
        ["qa"],
        """select seq, question, array_to_string(answer, '.') as answer_text, record_id as first_record_id,
       cast(len(answer) as integer) as n_answers
from qa""",
    ),
)
def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.functions import answer_text as at, example_json, first_record_id, parse_example

    qa = S.qa(spark, sf_dir).withColumn("ecg_id", F.array("record_id"))
    # PRJ-3: example row -> JSON text -> row (what travels with a sample), never eval
    as_json = qa.select(example_json("seq", "question", "answer", "ecg_id").alias("example"))
    schema = "seq bigint, question string, answer array<string>, ecg_id array<bigint>"
    back = as_json.select(parse_example("example", schema).alias("e")).select("e.*")
    return back.select(
        "seq", "question", at("answer").alias("answer_text"), first_record_id("ecg_id").alias("first_record_id"),
        F.size("answer").alias("n_answers"),
    )


@register(
    "lookup_last_wins",
    with_views(
        ["qa"],
        """select question, record_id, array_to_string(arg_max(answer, seq), '.') as answer_text,
       count(*) as n_rows, max(seq) as last_seq
from qa group by question, record_id""",
    ),
)
def lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.qa import lookup_last_wins as llw

    lk = llw(S.qa(spark, sf_dir))
    return lk.select("question", "record_id", F.array_join("answer", ".").alias("answer_text"), "n_rows", "last_seq")


@register(
    "grouped_shuffle_pos",
    with_views(["qa"], f"select seq, question, row_number() over (order by {_ORDER_GROUPED}) - 1 as pos from qa"),
)
def grouped_shuffle_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.plans.training import order_examples

    return order_examples(S.qa(spark, sf_dir), "grouped", 42).df.select("seq", "question", "pos")


@register(
    "global_shuffle_limit",
    with_views(
        ["qa"],
        """select * from (
  select seq, question, row_number() over (order by md5('42|' || seq), seq) - 1 as pos from qa)
where pos < 10000""",
    ),
)
def global_shuffle_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.plans.training import order_examples

    return order_examples(S.qa(spark, sf_dir), "global", 42, num_data=10000).df.select("seq", "question", "pos")


@register(
    "file_order_groups",
    with_views(
        ["qa"],
        """select seq, question, row_number() over (order by first_seq, seq) - 1 as pos
from (select seq, question, min(seq) over (partition by question) as first_seq from qa)""",
    ),
)
def file_order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.plans.training import order_examples

    return order_examples(S.qa(spark, sf_dir), "file").df.select("seq", "question", "pos")


@register("batch_assignment", with_views(["qa"], f"with {_BATCHED_SQL}\nselect seq, pos, batch_id, idx from batched"))
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched, _ = _batched(spark, sf_dir)
    return batched.select("seq", "pos", "batch_id", "idx")


@register(
    "batch_columns",
    with_views(
        ["qa"],
        f"""with {_BATCHED_SQL}
select batch_id, count(*) as n,
       string_agg(cast(seq as varchar), ',' order by idx) as seqs,
       string_agg(question, '|' order by idx) as questions,
       string_agg(array_to_string(answer, '.'), '|' order by idx) as answers
from batched group by batch_id""",
    ),
)
def batch_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.qa import batch_columns as bc

    batched, _ = _batched(spark, sf_dir)
    cols = bc(batched, ["seq", "question", "answer"])
    return cols.select(
        "batch_id",
        F.size("seq").cast("bigint").alias("n"),
        F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seqs"),
        F.array_join("question", "|").alias("questions"),
        F.array_join(F.transform("answer", lambda a: F.array_join(a, ".")), "|").alias("answers"),
    )


@register(
    "batch_hook",
    with_views(
        ["qa"],
        f"""with {_BATCHED_SQL}
select batch_id, count(*) as n, count(distinct question) as n_questions, max(len(answer)) as longest from batched group by batch_id""",
    ),
)
def batch_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-1: a caller's collate step on the packed batches, as a DataFrame transformation."""
    from wavequery.operators.qa import collate_batches

    def hook(packed: DataFrame) -> DataFrame:
        return packed.select(
            "batch_id",
            F.size("question").cast("bigint").alias("n"),
            F.size(F.array_distinct("question")).cast("bigint").alias("n_questions"),
            F.array_max(F.transform("answer", F.size)).cast("bigint").alias("longest"),
        )

    batched, _ = _batched(spark, sf_dir)
    return collate_batches(batched, ["question", "answer"], hook)


@register(
    "example_at",
    with_views(["qa"], f"with {_BATCHED_SQL}\nselect seq, question, pos from ordered where pos = (select count(*) // 2 from ordered)"),
)
def example_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-2: the example at a position of the whole ordered list (here: the middle)."""
    from wavequery.operators.qa import example_at as at
    from wavequery.plans.training import order_examples

    numbered = order_examples(S.qa(spark, sf_dir), "grouped", 42)
    return at(numbered.df, numbered.total // 2).select("seq", "question", "pos")


@register(
    "file_positions",
    with_views(
        ["qa"],
        """select seq as sample_id, row_number() over (order by attribute_type, question, seq) - 1 as pos from qa""",
    ),
)
def file_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-9: positions by (template, question, sample) keys."""
    from wavequery.sources.annotations import file_positions as fp

    ann = S.qa(spark, sf_dir).select(
        F.col("attribute_type").alias("template_id"), F.col("question").alias("question_id"), F.col("seq").alias("sample_id")
    )
    return fp(ann, pos="pos").select("sample_id", "pos")


@register("pair_scores", with_views(["qa"], f"with {_BATCHED_SQL}\nselect batch_id, i, j, score, known from scores"))
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs = _batched(spark, sf_dir)
    return pairs


@register(
    "pair_score_matrix",
    with_views(
        ["qa"],
        f"""with {_BATCHED_SQL},
r as (select batch_id, i, string_agg(printf('%.6f', score), ',' order by j) as row_text from scores group by batch_id, i)
select batch_id, string_agg(row_text, ';' order by i) as matrix from r group by batch_id""",
    ),
)
def pair_score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.plans.training import training_score_matrices

    m = training_score_matrices(S.qa(spark, sf_dir), batch_size=32, mode="grouped", seed=42, drop_last=True)
    text = F.array_join(
        F.transform("matrix", lambda r: F.array_join(F.transform(r, lambda x: F.format_string("%.6f", x)), ",")), ";"
    )
    return m.select("batch_id", text.alias("matrix"))


# --------------------------------------------------------------------------- signals

# Supplied lead-combination weights (lead, tap, integer weight) for the 5 stand-in leads.
LEAD_WEIGHTS = [
    ("click", 0, 1), ("click", 1, -2), ("click", 2, 3),
    ("error", 0, 2), ("error", 1, 1), ("error", 2, -1),
    ("purchase", 0, -1), ("purchase", 1, 3), ("purchase", 2, 2),
    ("signup", 0, 3), ("signup", 1, 0), ("signup", 2, 1),
    ("view", 0, 1), ("view", 1, 1), ("view", 2, 1),
]
_WEIGHTS_SQL = "weights(lead, k, w) as (values " + ", ".join(f"('{l}', {k}, {w})" for l, k, w in LEAD_WEIGHTS) + ")"

_TOP_LAGS_SQL = """
ac as (
  select a.record_id, (b.t - a.t + a.n) % a.n as lag, sum(a.vc * b.vc) as corr
  from signals_one a join signals_one b on a.record_id = b.record_id group by 1, 2),
top_lags as (
  select record_id, lag, row_number() over (partition by record_id order by corr desc, lag) as rank from ac)"""

_STATS_SQL = """
stats as (
  select record_id, min(v) as min_v, max(v) as max_v, quantile_disc(v, 0.5) as median_v,
         arg_max(v, t) - arg_min(v, t) as trend, count(*) as n
  from signals_one group by record_id)"""


@register(
    "lead_zscore",
    with_views(
        ["signals"],
        """select record_id, lead, t, round((v - avg(v) over w) / (case when stddev_pop(v) over w = 0 then 1 else stddev_pop(v) over w end), 6) as z
from signals window w as (partition by record_id, lead)""",
    ),
)
def lead_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.signals import zscore

    scaled, _ = zscore(S.signals(spark, sf_dir), ["record_id", "lead"])
    return scaled.select("record_id", "lead", "t", F.round("z", 6).alias("z"))


@register(
    "lead_inverse",
    with_views(
        ["signals"],
        """select record_id, lead, t, round(v, 6) as v_back, cast(stddev_pop(v) over w = 0 as boolean) as flat
from signals window w as (partition by record_id, lead)""",
    ),
)
def lead_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.signals import inverse_zscore, zscore

    keys = ["record_id", "lead"]
    scaled, _ = zscore(S.signals(spark, sf_dir), keys)
    back = inverse_zscore(scaled, keys=keys)
    return back.select("record_id", "lead", "t", F.round("v_back", 6).alias("v_back"), "flat")


@register(
    "lead_unscaled",
    with_views(["signals"], "select record_id, lead, t, cast(v as double) as z, round(avg(v) over (partition by record_id, lead), 6) as mean from signals"),
)
def lead_unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-3: with scaling off values pass through; the parameters are fitted all the same."""
    from wavequery.operators.signals import zscore

    keys = ["record_id", "lead"]
    same, params = zscore(S.signals(spark, sf_dir), keys, scale=False)
    return same.join(params, keys).select(*keys, "t", "z", F.round("mean", 6).alias("mean"))


@register(
    "first_differences",
    with_views(
        ["signals_one"],
        "select record_id, t, round(v - lag(v) over (partition by record_id order by t), 6) as dv from signals_one",
    ),
)
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.signals import first_differences as fd

    sig = S.signals_one(spark, sf_dir).select("record_id", "t", "v")
    return fd(sig, ["record_id"]).select("record_id", "t", F.round("dv", 6).alias("dv"))


@register(
    "series_stats",
    with_views(
        ["signals_one"],
        f"""with {_STATS_SQL}
select record_id, min_v, max_v, median_v, round(trend, 6) as trend,
       case when trend > 0 then 'upward' else 'downward' end as trend_word, n
from stats""",
    ),
)
def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.functions import trend_word
    from wavequery.operators.signals import series_stats as st

    s = st(S.signal_rows(spark, sf_dir), ["record_id"], t="at")
    return s.select("record_id", "min_v", "max_v", "median_v", F.round("trend", 6).alias("trend"),
                    trend_word("trend").alias("trend_word"), "n")


@register(
    "series_patches",
    with_views(
        ["signals_one"],
        """with info as (select record_id, count(*) as n, arg_max(v, t) as last_v from signals_one group by record_id),
p as (select record_id, n, last_v, unnest(range(0, cast(floor((n + 8 - 16) / 8) + 1 as bigint))) as patch_id from info where n + 8 >= 16),
o as (select record_id, n, last_v, patch_id, unnest(range(0, 16)) as "offset" from p)
select o.record_id, patch_id, cast("offset" as integer) as "offset",
       case when patch_id * 8 + "offset" < o.n then s.v else o.last_v end as v
from o left join signals_one s on s.record_id = o.record_id and s.t = patch_id * 8 + "offset" """,
    ),
)
def series_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.signals import patches_long

    return patches_long(S.signals_one(spark, sf_dir).select("record_id", "t", "v"), ["record_id"], 16, 8)


@register(
    "lead_combine",
    with_views(
        ["signals"],
        f"""with {_WEIGHTS_SQL},
lens as (select record_id, lead, count(*) as tl from signals group by 1, 2),
x as (select s.*, tl from signals s join lens using (record_id, lead)),
c as (select x.record_id, ((x.t - weights.k + 1) % tl + tl) % tl as t, weights.w * x.vc as part
      from x join weights on weights.lead = x.lead)
select record_id, t, cast(sum(part) as bigint) as y from c group by record_id, t""",
    ),
)
def lead_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.signals import combine_leads

    weights = spark.createDataFrame(LEAD_WEIGHTS, "lead string, k int, w bigint")
    sig = S.signals(spark, sf_dir).select("record_id", "lead", "t", F.col("vc").alias("v"))
    out = combine_leads(sig, weights)
    return out.select("record_id", F.col("t").cast("bigint").alias("t"), F.col("y").cast("bigint").alias("y"))


def _lags_one(spark: SparkSession, sf_dir: str, sig: DataFrame | None = None) -> DataFrame:
    from wavequery.operators.signals import top_lags_long

    sig = sig if sig is not None else S.signals_one(spark, sf_dir)
    long = sig.select("record_id", "t", F.col("vc").cast("double").alias("v"))
    return top_lags_long(long, ["record_id"])


@register(
    "autocorr_top_lags",
    with_views(["signals_one"], f"with {_TOP_LAGS_SQL}\nselect record_id, cast(rank as integer) as rank, lag from top_lags where rank <= 5"),
)
def autocorr_top_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = _lags_one(spark, sf_dir)
    return lags.select("record_id", F.posexplode("lags").alias("rank", "lag")).select(
        "record_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("lag").cast("bigint").alias("lag")
    )


# fixed values: the prompt text
_PROMPT_SQL = """lag_text as (select record_id, '[' || string_agg(cast(lag as varchar), ', ' order by rank) || ']' as lags_text
             from top_lags where rank <= 5 group by record_id)
select qa.seq, qa.record_id,
  '<|start_prompt|>Dataset description: The dataset contains electrocardiogram (ECG) time-series data. '
  || 'Task description: Given a patient''s ECG signal, answer a clinical question related to cardiac health based on the ECG data. '
  || 'Input statistics: min value ' || printf('%.4f', min_v) || ', max value ' || printf('%.4f', max_v)
  || ', median value ' || printf('%.4f', median_v) || ', the trend of the signal is '
  || case when trend > 0 then 'upward' else 'downward' end || ', top 5 lags are: ' || lags_text
  || '. Question:' || qa.question || '<|end_prompt|><|start_ecg|>' as prompt_prefix,
  '<|end_ecg|>Answer:' as prompt_suffix,
  array_to_string(answer, '.') || '<|end_of_text|>' as answer_text
from qa join stats using (record_id) join lag_text using (record_id)"""


@register(
    "prompt_text",
    with_views(["qa", "signals_one"], f"with {_STATS_SQL}, {_TOP_LAGS_SQL}, {_PROMPT_SQL}"),
)
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.prompts import build_prompts
    from wavequery.operators.signals import series_stats as st

    sig = S.signals_one(spark, sf_dir)
    stats = st(sig, ["record_id"])
    lags = _lags_one(spark, sf_dir, sig)
    features = stats.join(lags, "record_id")
    out = build_prompts(S.qa(spark, sf_dir), features)
    return out.select("seq", "record_id", "prompt_prefix", "prompt_suffix", "answer_text")


_COMBINED_SQL = f"""{_WEIGHTS_SQL},
lens as (select record_id, lead, count(*) as tl from signals group by 1, 2),
c as (select s.record_id, ((s.t - weights.k + 1) % tl + tl) % tl as t, weights.w * s.vc as part
      from signals s join lens using (record_id, lead) join weights on weights.lead = s.lead),
signals_one as (
  select record_id, t, cast(sum(part) as double) as v, cast(sum(part) as bigint) as vc, count(*) over (partition by record_id) as n
  from c group by record_id, t)"""


def _combined_features(spark: SparkSession, sf_dir: str):
    from wavequery.plans.features import series_features

    weights = spark.createDataFrame(LEAD_WEIGHTS, "lead string, k int, w bigint")
    return series_features(S.signals(spark, sf_dir).select("record_id", "lead", "t", F.col("vc").alias("v")), weights)


@register(
    "combined_prompt_text",
    with_views(["qa", "signals"], f"with {_COMBINED_SQL}, {_STATS_SQL}, {_TOP_LAGS_SQL}, {_PROMPT_SQL}"),
)
def combined_prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow 2 whole: leads combined, then statistics and lags of the combined series, then prompts."""
    from wavequery.plans.features import prompts_for

    out = prompts_for(S.qa(spark, sf_dir), _combined_features(spark, sf_dir))
    return out.select("seq", "record_id", "prompt_prefix", "prompt_suffix", "answer_text")


@register(
    "combined_patches",
    with_views(
        ["signals"],
        f"""with {_COMBINED_SQL},
info as (select record_id, count(*) as n, arg_max(v, t) as last_v from signals_one group by record_id),
p as (select record_id, n, last_v, unnest(range(0, cast(floor((n + 8 - 16) / 8) + 1 as bigint))) as patch_id from info where n + 8 >= 16),
o as (select record_id, n, last_v, patch_id, unnest(range(0, 16)) as k from p)
select o.record_id, cast(patch_id * 16 + k as integer) as d, case when patch_id * 8 + k < o.n then s.v else o.last_v end as x
from o left join signals_one s on s.record_id = o.record_id and s.t = patch_id * 8 + k""",
    ),
)
def combined_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of the combined series, flattened to one vector per record (VEC-1), in long form."""
    patches = _combined_features(spark, sf_dir).patches_long
    return patches.select("record_id", (F.col("patch_id") * 16 + F.col("offset")).cast("int").alias("d"), F.col("v").alias("x"))


@register("patch_vectors", ORACLE["combined_patches"])
def patch_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-1: a record's patches as a matrix, flattened to its vector by the operator."""
    from wavequery.operators.vectors import flatten_matrix

    vectors = flatten_matrix(_combined_features(spark, sf_dir).patches, "patches")
    return vectors.select("record_id", F.posexplode("vec").alias("d", "x"))


@register(
    "fixed_text",
    """select event_id, printf('%.4f', (event_id % 4096 - 2048) / 32.0::double) as tie, printf('%.4f', value / 7.0::double) as plain,
       printf('%.4f', (event_id % 977 - 488) * 0.00005::double) as near from events""",
)
def fixed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-4: four-decimal text with many exact ties (multiples of 1/32) and values next to ties."""
    from wavequery.functions import fixed4

    k = F.col("event_id")
    return S.table(spark, sf_dir, "events").select(
        "event_id", fixed4((k % 4096 - 2048) / F.lit(32.0)).alias("tie"), fixed4(F.col("value") / F.lit(7.0)).alias("plain"),
        fixed4((k % 977 - 488) * F.lit(0.00005)).alias("near"),
    )


# --------------------------------------------------------------------------- vectors

_UNIT_SQL = """
vlong as (select vec_id, batch_id, idx, label, unnest(range(len(embedding))) as d, unnest(embedding) as x from vectors),
vnorm as (select vec_id, sqrt(sum(x * x)) as norm from vlong group by vec_id),
unit as (select vlong.*, x / norm as ux, norm from vlong join vnorm using (vec_id))"""


@register(
    "vector_normalize",
    with_views(["vectors"], f"with {_UNIT_SQL}\nselect vec_id, cast(d as integer) as d, round(ux, 6) as u, round(norm, 6) as norm from unit"),
)
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.vectors import normalize_vectors

    v = normalize_vectors(S.vectors(spark, sf_dir))
    return v.select("vec_id", F.posexplode("unit").alias("d", "u"), "norm").select(
        "vec_id", F.col("d").cast("int").alias("d"), F.round("u", 6).alias("u"), F.round("norm", 6).alias("norm")
    )


@register(
    "batch_cosine",
    with_views(
        ["vectors"],
        f"""with {_UNIT_SQL}
select a.batch_id, a.idx as i, b.idx as j, round(sum(a.ux * b.ux), 6) as sim
from unit a join unit b on a.batch_id = b.batch_id and a.d = b.d group by 1, 2, 3""",
    ),
)
def batch_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.vectors import batch_cosine as bc

    return bc(S.vectors(spark, sf_dir)).select("batch_id", "i", "j", F.round("sim", 6).alias("sim"))


@register(
    "batch_similarity_mse",
    with_views(
        ["vectors", "qa", "predictions"],
        f"""with {_BATCHED_SQL}, {_SCORED_SQL},
unit as (select vec_id, embedding as e, sqrt(list_dot_product(embedding, embedding)) as norm from vectors),
ex as (
  select batch_id, idx, e, norm
  from (select batch_id, idx, record_id % (select count(*) from vectors) as vec_id from batched) join unit using (vec_id)),
sim as (
  select a.batch_id, a.idx as i, b.idx as j, list_dot_product(a.e, b.e) / (a.norm * b.norm) as sim
  from ex a join ex b on a.batch_id = b.batch_id),
per_batch as (select batch_id, count(*) as n_cells, avg(power(sim - score, 2)) as sim_mse
              from sim join scores using (batch_id, i, j) group by batch_id),
missed as (select batch_id, avg(case when correct then 0.0 else 1.0 end) as miss
           from (select seq, correct from judged) join batched using (seq) group by batch_id),
losses as (select batch_id, n_cells, sim_mse, 0.5 * miss + 0.5 * sim_mse as loss from per_batch join missed using (batch_id))
select batch_id, 0 as level, n_cells, round(sim_mse, 6) as sim_mse, round(loss, 6) as loss from losses
union all
select null, 1, count(*), round(avg(sim_mse), 6), round(avg(loss), 6) from losses""",
    ),
)
def batch_similarity_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity and score matrices of the same batches of examples, compared as row vectors (JN-4, AGG-14),
    combined with each batch's share of wrong predictions (PRJ-11) and averaged over batches (AGG-13).

    Stand-in: an example's vector is that of its record, numbered round the vector table."""
    from wavequery.operators.qa import pair_score_rows
    from wavequery.operators.vectors import combined_loss, cosine_rows, similarity_mse_rows, with_mean_of_batches
    from wavequery.plans.training import batches_and_lookup

    batched, lookup = batches_and_lookup(S.qa(spark, sf_dir), 32, "grouped", 42)
    vectors = S.vectors(spark, sf_dir).select("vec_id", "embedding")
    mine = batched.select("batch_id", "idx", (F.col("record_id") % max(vectors.count(), 1)).alias("vec_id"))
    sims = cosine_rows(mine.join(vectors, "vec_id", "left"))
    per_batch = similarity_mse_rows(sims, pair_score_rows(batched, lookup))
    scored = EV.mark_correct(EV.attach_predictions(batched, S.predictions(spark, sf_dir)))
    missed = scored.groupBy("batch_id").agg(F.avg((~F.col("correct")).cast("double")).alias("miss"))
    losses = per_batch.join(missed, "batch_id").withColumn("loss", combined_loss("miss", "sim_mse"))
    out = with_mean_of_batches(losses, ["sim_mse", "loss"], "n_cells")
    return out.select("batch_id", "level", "n_cells", F.round("sim_mse", 6).alias("sim_mse"), F.round("loss", 6).alias("loss"))


@register(
    "prototype_blend",
    with_views(
        ["vectors"],
        """with vlong as (select vec_id, label, unnest(range(len(embedding))) as d, unnest(embedding) as x from vectors),
protos as (select label as key, d, avg(x) as m from vlong group by label, d),
scores as (select l.vec_id, l.d // 32 as head, p.key, sum(l.x * p.m) / sqrt(32) as s
           from vlong l join protos p on l.d = p.d group by 1, 2, 3),
e as (select vec_id, head, key, exp(s - max(s) over (partition by vec_id, head)) as e from scores)
select vec_id, cast(head as integer) as head, key, round(e / sum(e) over (partition by vec_id, head), 6) as w from e""",
    ),
)
def prototype_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.vectors import mean_prototypes, prototype_blend as pb

    v = S.vectors(spark, sf_dir)
    out = pb(v.select("vec_id", "embedding"), mean_prototypes(v), n_heads=2)
    per_head = out.select("vec_id", "proto_keys", F.posexplode("weights").alias("head", "hw"))
    return per_head.select(
        "vec_id", F.col("head").cast("int").alias("head"),
        F.posexplode(F.arrays_zip(F.col("proto_keys").alias("key"), F.col("hw").alias("w"))).alias("_j", "x"),
    ).select("vec_id", "head", F.col("x.key").alias("key"), F.round("x.w", 6).alias("w"))


@register(
    "prototype_values",
    with_views(
        ["vectors"],
        """with vlong as (select vec_id, label, unnest(range(len(embedding))) as d, unnest(embedding) as x from vectors),
protos as (select label as key, d, avg(x) as k, max(x) as v from vlong group by label, d),
scores as (select l.vec_id, l.d // 32 as head, p.key, sum(l.x * p.k) / sqrt(32) as s
           from vlong l join protos p on l.d = p.d group by 1, 2, 3),
e as (select vec_id, head, key, exp(s - max(s) over (partition by vec_id, head)) as e from scores),
w as (select vec_id, head, key, e / sum(e) over (partition by vec_id, head) as w from e)
select vec_id, cast(d as integer) as d, round(sum(w * v), 6) as x
from w join protos using (key) where d // 32 = head group by vec_id, d""",
    ),
)
def prototype_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-4's blended output with values other than the keys (keys: a label's means, values: its maxima)."""
    from wavequery.operators.vectors import mean_prototypes, prototype_blend as pb

    v = S.vectors(spark, sf_dir)
    peaks = v.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.max("x").alias("x"))
    peaks = peaks.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("value"))
    out = pb(v.select("vec_id", "embedding"), mean_prototypes(v).join(peaks, "label"), n_heads=2, value_col="value", weights=False)
    return out.select("vec_id", F.posexplode("blend").alias("d", "x")).select("vec_id", "d", F.round("x", 6).alias("x"))


# --------------------------------------------------------------------------- token sequences

# Stand-in token ids: a word's id is its length + 3 (0 pad, 1 begin, 2 end are reserved);
# prefix = begin + the turn's words, suffix = a fixed 3-token template, answer = begin + role word + end,
# 4 series positions between prefix and suffix.
_SEQ_SQL = """
seg as (
  select batch_id, turn,
         list_concat([1], list_transform(tok, lambda w: length(w) + 3)) as prefix,
         [1, 7, 8] as suffix,
         [1, length(role) + 3, 2] as answer,
         [1, 2] as blank
  from tokens),
parts as (
  select *, list_slice(prefix, 1, 512) as p, list_slice(suffix, 2, len(suffix)) as s, list_slice(answer, 2, len(answer)) as a,
         list_slice(blank, 2, len(blank)) as ab, len(prefix) > 512 as truncated
  from seg),
seqs as (
  select *, list_concat(p, [-1, -1, -1, -1], s, a) as ids,
         list_concat(list_transform(range(len(p) + 4 + len(s)), lambda x: -100), a) as labels,
         list_concat(p, [-1, -1, -1, -1], s, ab) as eval_ids
  from parts),
lens as (select *, len(ids) as seq_len, max(len(ids)) over (partition by batch_id) as max_len from seqs)"""


def _int_text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@register(
    "sequence_collate",
    with_views(
        ["tokens"],
        f"""with {_SEQ_SQL}
select batch_id, turn, cast(seq_len as integer) as seq_len, cast(max_len as integer) as max_len, truncated,
       cast(len(list_filter(labels, lambda x: x <> -100)) as integer) as n_targets,
       array_to_string(list_concat(list_transform(range(max_len - seq_len), lambda x: 0), ids), ' ') as input_text,
       array_to_string(list_concat(list_transform(range(max_len - seq_len), lambda x: -100), labels), ' ') as labels_text,
       array_to_string(list_concat(list_transform(range(max_len - seq_len), lambda x: 0),
                                   list_transform(range(seq_len), lambda x: 1)), ' ') as mask_text,
       cast(len(eval_ids) - 1 as integer) as gen_len
from lens""",
    ),
)
def sequence_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.sequences import (
        assemble, collate, drop_begin, generation_input, series_positions, target_count, truncate,
    )

    t = S.tokens(spark, sf_dir)
    seg = t.select(
        "batch_id", "turn",
        F.concat(F.array(F.lit(1)), F.transform("tok", lambda w: F.length(w) + 3)).alias("prefix"),
        F.array(F.lit(1), F.lit(7), F.lit(8)).alias("suffix"),
        F.array(F.lit(1), F.length("role") + 3, F.lit(2)).alias("answer"),
        F.array(F.lit(1), F.lit(2)).alias("blank"),
    )
    a = assemble(seg, "prefix", "suffix", "answer", 4)
    # evaluation mode (SEQ-6): same segments with a blank answer, last position dropped
    eval_ids = F.concat(truncate("prefix"), series_positions(4), drop_begin(truncate("suffix")), drop_begin(truncate("blank")))
    a = a.withColumn("gen_len", F.size(generation_input(eval_ids)))
    c = collate(a)
    return c.select(
        "batch_id", "turn", "seq_len", "max_len", "truncated", target_count("labels").alias("n_targets"),
        _int_text("input_ids_padded").alias("input_text"), _int_text("labels_padded").alias("labels_text"),
        _int_text("attention_mask").alias("mask_text"), "gen_len",
    )


# --------------------------------------------------------------------------- run monitoring

_EARLY_SQL = """
es as (
  select *, -val_loss as score, row_number() over w as rn,
         max(-val_loss) over (w rows between unbounded preceding and 1 preceding) as best_before
  from run_metrics window w as (partition by run_id order by epoch)),
imp as (select *, best_before is null or score >= best_before as improved from es),
cnt as (select *, rn - max(case when improved then rn end) over (partition by run_id order by epoch rows between unbounded preceding and current row) as counter,
               -max(score) over (partition by run_id order by epoch rows between unbounded preceding and current row) as best_loss
        from imp)"""


@register(
    "early_stopping",
    with_views(
        ["run_metrics"],
        f"""with {_EARLY_SQL}
select run_id, epoch, val_loss, improved, best_loss, cast(counter as integer) as counter,
       max(case when counter >= 5 then 1 else 0 end) over (partition by run_id order by epoch rows between unbounded preceding and current row) = 1 as stop
from cnt""",
    ),
)
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavequery.operators.runs import early_stopping as es

    return es(S.run_metrics(spark, sf_dir), patience=5).select(
        "run_id", "epoch", "val_loss", "improved", "best_loss", "counter", "stop"
    )


EARLY_DELTA = 0.5


@register(
    "early_stopping_delta",
    with_views(
        ["run_metrics"],
        f"""with m as (select run_id, epoch, val_loss, row_number() over (partition by run_id order by epoch) as rn from run_metrics),
f as (
  select run_id, epoch, rn, val_loss, true as improved, -val_loss as best, 0 as counter, false as stop from m where rn = 1
  union all
  select m.run_id, m.epoch, m.rn, m.val_loss, -m.val_loss >= f.best + {EARLY_DELTA},
         case when -m.val_loss >= f.best + {EARLY_DELTA} then -m.val_loss else f.best end,
         case when -m.val_loss >= f.best + {EARLY_DELTA} then 0 else f.counter + 1 end,
         f.stop or (case when -m.val_loss >= f.best + {EARLY_DELTA} then 0 else f.counter + 1 end) >= 5
  from f join m on m.run_id = f.run_id and m.rn = f.rn + 1)
select run_id, epoch, val_loss, improved, -best as best_loss, cast(counter as integer) as counter, stop from f""",
    ).replace("with ", "with recursive ", 1),
)
def early_stopping_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general ordered fold with a margin: an epoch must beat the best by delta to count."""
    from wavequery.operators.runs import early_stopping_fold

    return early_stopping_fold(S.run_metrics(spark, sf_dir), patience=5, delta=EARLY_DELTA)


#: Epochs of a chunk: small, so that the runs of the tables fall into several.
RUN_CHUNK = 8


@register("early_stopping_chunked", ORACLE["early_stopping_delta"])
def early_stopping_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule with a margin, composed over chunks of a run that are worked on by different tasks."""
    from wavequery.operators.runs import early_stopping_chunked as es

    return es(S.run_metrics(spark, sf_dir), patience=5, delta=EARLY_DELTA, chunk=RUN_CHUNK)


@register(
    "loss_history",
    with_views(
        ["run_metrics"],
        """select 'train' as split, event_type as run_id, cast(date_diff('hour', timestamp '2024-01-01', date_trunc('hour', ts)) as bigint) as step,
       cast(sum(cast(round(value * 100) as bigint)) as double) / count(*) as loss
from events group by 2, 3
union all
select 'valid', run_id, epoch * 24 + 23, val_loss from run_metrics""",
    ),
)
def loss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train history: mean value in cents per (type, hour); validation history: run_metrics at the end of each day.

    Both are exact rationals (integer sums over counts), so no rounding is needed to compare engines."""
    from wavequery.operators.runs import loss_history as lh

    ev = S.table(spark, sf_dir, "events")
    # hours since 2024-01-01 from the date and the hour of day (no session time zone involved)
    step = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("bigint")
    cents = F.round(F.col("value") * 100).cast("bigint")
    train = ev.groupBy(F.col("event_type").alias("run_id"), step.alias("step")).agg(
        (F.sum(cents).cast("double") / F.count(F.lit(1))).alias("loss")
    )
    val = S.run_metrics(spark, sf_dir).select("run_id", (F.col("epoch") * 24 + 23).alias("step"), F.col("val_loss").alias("loss"))
    return lh(train, val)


# --------------------------------------------------------------------------- streaming

@register(
    "stream_early_stop",
    with_views(
        ["run_metrics"],
        f"""with {_EARLY_SQL}
select run_id, epoch, val_loss, improved, best_loss, cast(counter as integer) as counter,
       max(case when counter >= 5 then 1 else 0 end) over (partition by run_id order by epoch rows between unbounded preceding and current row) = 1 as stop,
       false as late
from cnt""",
    ),
)
def stream_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics arrive in two waves (epochs < 15, then the rest); the query is restarted from
    its checkpoint between them, so the per-run state must survive the restart."""
    from wavequery.streaming.monitor import early_stop_monitor
    from wavequery.streaming.runner import run_append, scratch, stage

    rm = S.run_metrics(spark, sf_dir)
    root = scratch(spark, "stream-early-stop")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    for wave in (rm.where(F.col("epoch") < 15), rm.where(F.col("epoch") >= 15)):
        stage([wave], src)
        stream = spark.readStream.schema(rm.schema).parquet(src)
        run_append(early_stop_monitor(stream, patience=5), sink, ckpt)
    return spark.read.parquet(sink)


#: Files of one micro-batch.
FILES_PER_TRIGGER = 64


@register("stream_accuracy", ORACLE["accuracy_by_question_type"])
def stream_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions arrive in micro-batches of files and are joined to the static examples."""
    from wavequery.streaming.accuracy import running_accuracy
    from wavequery.streaming.runner import run_complete, scratch, stage

    preds = S.predictions(spark, sf_dir)
    root = scratch(spark, "stream-accuracy")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    stage([preds], src)
    stream = spark.readStream.schema(preds.schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(src)
    # the static side is written once, not worked out anew for every trigger
    run_complete(running_accuracy(stream, written(S.qa(spark, sf_dir), "examples")), sink, ckpt)
    return spark.read.parquet(sink)


@register("stream_accuracy_dedup", ORACLE["accuracy_by_question_type"])
def stream_accuracy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2 with bounded state: predictions arrive by their orders' dates in two waves, the second repeats rows of the month before it; a third
    brings old rows again, long after their keys have left the state. Each run goes on from the checkpoint of the one before."""
    from wavequery.streaming.accuracy import running_accuracy
    from wavequery.streaming.runner import run_complete, scratch, stage

    dates = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("at"))
    preds = written(S.predictions(spark, sf_dir).join(dates, "seq"), "dated")
    middle = F.lit("1998-06-01").cast("timestamp")
    month_before = (F.col("at") < middle) & (F.col("at") >= F.lit("1998-05-01").cast("timestamp"))
    waves = (preds.where(F.col("at") < middle), preds.where((F.col("at") >= middle) | month_before), preds.where(F.col("at") < F.lit("1997-01-01").cast("timestamp")))
    examples = written(S.qa(spark, sf_dir), "examples")
    root = scratch(spark, "stream-dedup")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    for wave in waves:
        stage([wave], src)
        stream = spark.readStream.schema(preds.schema).parquet(src)
        run_complete(running_accuracy(stream, examples, event_time="at", delay="60 days"), sink, ckpt)
    return spark.read.parquet(sink)


# --------------------------------------------------------------------------- sinks

@register(
    "annotation_roundtrip",
    with_views(
        ["qa", "predictions"],
        f"""with {_SCORED_SQL},
ordered as (select seq, row_number() over (order by {_ORDER_GROUPED}) - 1 as pos from qa)
select seq, pos, question_type, array_to_string(answer, '.') as answer_text,
       array_to_string(pred_list, '|') as prediction_text, correct
from judged join ordered using (seq)""",
    ),
)
def annotation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1 (prepared list + lookup materialised under a key of split/seed/shuffle/source, then
    reused), JN-3 (predictions aligned by key), SNK-2 (evaluation rows written and read back)."""
    from wavequery.plans.training import prepare
    from wavequery.sources.annotations import prepared_path, write_evaluation, write_prepared
    from wavequery.streaming.runner import scratch

    qa = S.qa(spark, sf_dir)
    root = scratch(spark, "prepared")
    prep = prepare(qa, mode="grouped", seed=42)
    path = prepared_path(root, "train", 42, True, "qa")
    write_prepared(prep.ordered, prep.lookup, path, source=qa)
    rows, _lookup = write_prepared(prep.ordered, prep.lookup, path, source=qa)  # second call reuses the materialisation
    scored = EV.mark_correct(EV.attach_predictions(rows, S.predictions(spark, sf_dir)))
    write_evaluation(scored, f"{root}/evaluation")
    back = spark.read.parquet(f"{root}/evaluation")
    return back.select(
        "seq", "pos", "question_type", F.array_join("answer", ".").alias("answer_text"),
        F.array_join("prediction", "|").alias("prediction_text"), "correct",
    )


_SPLIT_OF = {"train": 0, "valid": 1, "test": 2}
#: Bytes of an annotation array that one task reads at least.
ARRAY_SPLIT_BYTES = 1 << 18


@register(
    "annotation_files",
    with_views(
        ["qa"],
        """with s as (select *, case seq % 3 when 0 then 'train' when 1 then 'valid' else 'test' end as split from qa)
select split, seq as sample_id, row_number() over (partition by split order by seq) - 1 as pos, question, record_id,
       array_to_string(answer, '.') as answer_text
from s""",
    ),
)
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1/2: the examples as one JSON array per split, read back by byte ranges with their positions in the array."""
    from wavequery.sources.annotations import as_qa, read_split, write_array
    from wavequery.streaming.runner import scratch

    root = scratch(spark, "annotations")
    rows = written(S.qa(spark, sf_dir), "examples")
    record = F.struct(
        F.lit(0).alias("template_id"), F.lit(0).alias("question_id"), F.col("seq").alias("sample_id"), "question_type", "attribute_type",
        "question", "answer", F.array("record_id").alias("ecg_id"),
    )
    found = []
    for split, k in _SPLIT_OF.items():
        write_array(rows.where(F.col("seq") % 3 == k).select(record.alias("record"), "seq"), f"{root}/template_{split}.json", ["seq"])
        read = read_split(spark, root, split, split_bytes=ARRAY_SPLIT_BYTES)
        found.append(as_qa(read, "sample_id").withColumnRenamed("seq", "pos"))
    both = found[0].unionByName(found[1]).unionByName(found[2])
    return both.select("split", "sample_id", "pos", "question", "record_id", F.array_join("answer", ".").alias("answer_text"))


_BANK_NAMES = ["AUTOMOBILE", "BUILDING", "ETT", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register(
    "prompt_bank",
    """with c as (select *, case when c_nationkey % 5 = 0 then 'ETTh' || c_nationkey else c_mktsegment end as data from customer),
bank as (
  select case when data like '%ETT%' then 'ETT' else data end as name, count(*) as n, min(c_custkey) as first_key from c group by 1)
select c_custkey as record_id, data, 'The dataset ' || name || ' has ' || n || ' records.' || chr(10) || 'The first is ' || first_key || '.' || chr(10) as content
from c join bank on name = case when data like '%ETT%' then 'ETT' else data end""",
)
def prompt_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4: description files written per dataset name, read as the bank, and looked up: an ETT name has the ETT entry."""
    from wavequery.sources.annotations import prompt_for, read_prompt_bank
    from wavequery.streaming.runner import scratch

    root = scratch(spark, "prompt-bank")
    data = F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("ETTh"), "c_nationkey")).otherwise(F.col("c_mktsegment"))
    records = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), data.alias("data"))
    name = F.when(F.col("data").contains("ETT"), "ETT").otherwise(F.col("data"))
    counts = records.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_key"))
    text = F.format_string("The dataset %s has %d records.\nThe first is %d.", "name", "n", "first_key")
    counts = written(counts.select("name", text.alias("content")), "descriptions")
    for each in _BANK_NAMES:
        counts.where(F.col("name") == each).select("content").coalesce(1).write.text(f"{root}/{each}.txt")
    return prompt_for(records, read_prompt_bank(spark, root)).select("record_id", "data", "content")


@register("sample_files", with_views(["signals"], "select record_id, lead, t, cast(v as double) as v from signals"))
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: decoded samples read from files, packed per lead and unpacked again (PRJ-14)."""
    from wavequery.sources.signals import packed_signals, read_samples, unpacked_signals
    from wavequery.streaming.runner import scratch

    path = scratch(spark, "samples")
    S.signals(spark, sf_dir).select("record_id", "lead", "t", "v").write.parquet(path)
    return unpacked_signals(packed_signals(read_samples(spark, path), record="record_id"), record="record_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
