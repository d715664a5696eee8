"""The operators on the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embeddings, hard_negatives, langid, maxscore, packing, ranked_search, secrets, simhash, token_counts, toxicity, urlfilter, warc
from .common import table

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTED = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORDS)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    usable = toxicity.training_rows()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable)
    held = F.coalesce(~usable, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted")


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    usable = langid.training_rows()
    model = langid.fit(docs.where(usable))
    held = F.coalesce(~usable, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held, "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), BYTES, public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, ranked_search.query_terms(table(spark, sf_dir, "benchmark")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), COUNTED)


def _url_sql() -> str:
    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    ordered = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in ordered)
    said = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in ordered)
    shape = "regexp_replace({}, '[0-9]+', '#', 'g')"
    return f"""with recursive split as (select row_number() over () as rid, page_id, {host} as host, {path} as path from pages),
parts as (select *, string_split(host, '.') as labels, list_filter(string_split(path, '/'), lambda x: x <> '') as dirs from split),
urls as (select rid, page_id, host, path, case {rule} end as rule, case {said} end as said,
  list_sort(list_filter([
    case when host <> '' then 'top=' || labels[-1] end,
    case when len(labels) >= 2 then 'site=' || labels[-2] || '.' || labels[-1] end,
    case when host <> '' then 'host=' || host end,
    case when len(labels) >= 3 then 'sub=' || labels[1] end,
    case when len(dirs) >= 1 then 'dir1=' || {shape.format('dirs[1]')} end,
    case when len(dirs) >= 2 then 'dir2=' || {shape.format('dirs[2]')} end,
    case when len(dirs) >= 3 then 'rest=' || {shape.format("array_to_string(dirs[3:], '/')")} end,
    case when regexp_extract(path, '\\.([A-Za-z0-9]{{1,8}})$', 1) <> '' then 'ext=' || lower(regexp_extract(path, '\\.([A-Za-z0-9]{{1,8}})$', 1)) end,
    'depth=' || len(dirs)], lambda x: x is not null)) as tokens from parts),
labelled as (select * from urls where said is not null),
total as (select count(*) as n from labelled),
item as (select rid, said, unnest(tokens) as t from labelled),
sets as (
  select rid, said, [t] as a, t as last from item
  union all select s.rid, s.said, list_append(s.a, i.t), i.t from sets s join item i on i.rid = s.rid and i.t > s.last),
counts as (select a, said, count(*) as c from sets group by a, said),
alls as (select a, sum(c) as f from counts group by a),
rules as (select a, said as v, c::double / f as confidence, c::double / n as support
  from counts join alls using (a), total where c >= ceil({urlfilter.SUPPORT} * n) and c::double / f >= {urlfilter.CONFIDENCE}),
kept as (select * from rules r where not exists (
  select 1 from rules s where s.v = r.v and len(s.a) < len(r.a) and list_has_all(r.a, s.a) and s.confidence >= r.confidence)),
hits as (select rid, v, array_to_string(a, ' ') as mined,
  row_number() over (partition by rid order by confidence desc, support desc, len(a), array_to_string(a, ' ') desc, v desc) as k
  from urls join kept on list_has_all(tokens, a) where said is null)
select page_id, host, path, rule, coalesce(said, v, '{urlfilter.DEFAULT}') as verdict, mined
from urls left join (select * from hits where k = 1) using (rid)"""


def _secrets_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lists, empty = [], "[]::struct(s bigint, r int, e bigint, k varchar)[]"
    for i, r in enumerate(secrets.RULES):
        rx = quote(r.plain or r.pattern)
        hits = f"regexp_extract_all(t, {rx}, 0)"
        # a plain form may take in a character before the span, which is its group
        skip = f" + length({hits}[i]) - length(regexp_extract_all(t, {rx}, 1)[i])" if r.plain and "(eyJ" in r.plain else ""
        keep = f"regexp_extract_all(t, {rx}, {r.group})"
        starts = f"(list_sum(list_transform(regexp_split_to_array(t, {rx})[:i], lambda x: length(x))) + coalesce(list_sum(list_transform({hits}[:i - 1], lambda x: length(x))), 0))::bigint"
        lists.append(
            f"case when regexp_matches(t, {rx}) then list_transform(list_filter(range(1, len({hits}) + 1), lambda i: length({keep}[i]) >= {r.minimum}), "
            f"lambda i: {{'s': ({starts}{skip})::bigint, 'r': {i}, 'e': ({starts} + length({hits}[i]))::bigint, 'k': {quote(r.kind)}}}) else {empty} end"
        )
    # the short runs of letters a-f are a third of all text; long runs are the same spans
    joined = ", ".join(lists).replace("'[0-9a-f]+'", "'[0-9a-f]{16,}'")
    said = lambda s: f"array_to_string(list_transform({s}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    count = lambda k: f"len(list_filter(f, lambda x: x.k = '{k}'))::bigint as n_{k}"
    base = f"list_filter(f, lambda x: x.r < {len(secrets.BASE)})"
    return f"""with texts as (select doc_id, coalesce(text, '') as t from documents),
found as (select doc_id, list_sort(flatten([{joined}])) as f from texts)
select doc_id, {', '.join(count(r.kind) for r in secrets.BASE)}, sha256({said(base)}) as base_sha256, {said('f')} as spans from found"""


ORACLE = {
    "op2_url_filter": _url_sql(),
    "op3_warc": f"""with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select payload_digest, payload_bytes, max(page_id) as kept from p where payload_bytes >= {warc.MINIMUM} group by all having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when kept is not null and page_id is distinct from kept then 'revisit' else 'response' end as record_type,
case when page_id is distinct from kept then kept end as refers_to from p left join k using (payload_digest, payload_bytes)""",
    "op4_secrets": _secrets_sql(),
    "op5_embeddings": f"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
u as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {embeddings.THRESHOLD}),
reach as (select vec_id as a, vec_id as b from v union select reach.a, links.b from reach join links on reach.b = links.a)
select v.vec_id, (select count(*) from links where links.a = v.vec_id)::bigint as n_links, r.c as component_id, v.vec_id = r.c as kept
from v join (select a, min(b) as c from reach group by a) r on r.a = v.vec_id""",
    "op7_maxscore": """with i as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from i q join i c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op11_ranked_search": r"""with words as (
  select rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from (select row_number() over () as rid, doc_id, text from documents where text is not null)),
lengths as (select rid, doc_id, count(*)::bigint as n from words group by rid, doc_id),
sums as (select count(*)::bigint as docs, sum(n)::bigint as total from lengths),
tfs as (select rid, t, count(*)::bigint as tf from words group by rid, t),
weights as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select t, count(*)::bigint as df from tfs group by t), sums),
asked as (select qid, item_id, t, count(*)::bigint as times from (
  select qid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from (select row_number() over () as qid, item_id, text from benchmark where text is not null)) group by all),
scored as (select qid, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint as score
  from asked join weights using (t) join tfs using (t) join lengths using (rid), sums group by all),
ranked as (select *, row_number() over (partition by qid order by score desc, doc_id nulls last)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10""",
    "op12_hard_negatives": """with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= 5),
n as (select anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
  row_number() over (partition by anchor_id, p.vec_id order by s.score desc, s.vec_id)::int as rank
  from p join s using (anchor_id) where not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_url_filter, op3_warc, op4_secrets, op5_embeddings, op6_toxicity, op7_maxscore, op8_langid, op9_byte_bpe, op10_simhash, op11_ranked_search, op12_hard_negatives, op13_token_counts)
}
