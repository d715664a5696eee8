"""DuckDB forms of the stand-in views, inlined as CTEs into the oracle SQL."""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "qa": """
qa_answers as (
  select l_orderkey, list_sort(list(distinct l_returnflag || l_linestatus)) as answer
  from lineitem group by l_orderkey),
qa as (
  select o_orderkey as seq, o_orderpriority as question, o_orderpriority as question_type,
         c_mktsegment as attribute_type, o_custkey as record_id, answer
  from orders join customer on c_custkey = o_custkey join qa_answers on l_orderkey = o_orderkey)""",
    "predictions": """
predictions as (
  select l_orderkey as seq,
         ' ' || coalesce(array_to_string(list_sort(list(distinct case when l_quantity > 6 then l_returnflag || l_linestatus end)
                 filter (where l_quantity > 6)), '.'), '') || chr(10) as prediction
  from lineitem group by l_orderkey)""",
    "signals": """
signals as (
  select user_id as record_id, event_type as lead,
         row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as t,
         value as v, cast(round(value * 100) as bigint) as vc
  from events)""",
    "signals_one": """
signals_one as (
  select user_id as record_id,
         row_number() over (partition by user_id order by ts, event_id) - 1 as t,
         value as v, cast(round(value * 100) as bigint) as vc,
         count(*) over (partition by user_id) as n
  from events)""",
    "binary_labels": """
binary_labels as (
  select user_id as series_id,
         row_number() over (partition by user_id order by ts, event_id) - 1 as t,
         case when value > 20 then 1 else 0 end as gt,
         case when value > 45 then 1 else 0 end as pred
  from events)""",
    "run_metrics": """
run_metrics as (
  select event_type as run_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as epoch,
         cast(sum(cast(round(value * 100) as bigint)) as double) / count(*) as val_loss
  from events group by 1, 2)""",
    "vectors": """
vectors as (
  select vec_id, vec_id // 32 as batch_id, vec_id % 32 as idx, label, cast(embedding as double[]) as embedding
  from embeddings)""",
    "tokens": """
tokens as (
  select conv_id as batch_id, turn, role, regexp_split_to_array(text, '\\s+') as tok from conversations)""",
}


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (in the given order)."""
    ctes = ",".join(VIEWS[n] for n in names)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
