"""URL filtering by association rules; DataFrame functions and Spark's FP-growth only.

Curated rules (a host suffix and a path beginning) judge the urls they fit. The urls so labelled are the training data:
FP-growth mines combinations of url tokens and the verdict. Rules ``tokens -> verdict`` that reach the confidence
and support are kept, unless a part of their tokens says the same with no less confidence. The other urls get the verdict of
the best rule that they match; without any, ``DEFAULT``. Rules are matched by an inverted index: each is posted
under its rarest token, and what a url's tokens fetch is compared in full.

A url has at most 9 tokens, which name all its labels and directories (the first two directories on their own, all that follow as one), so
a label's itemsets are at most 2**10 times 1 / support, whatever the input: the rule table is bounded by these parameters and is
broadcast. Rules may have any number of tokens. Urls of any length are judged whole.

Null urls and urls without ``://`` have empty host and path; they are judged like any other. Best rule: confidence, support, fewer
tokens, then the last in text order. Curated rules that fit with equal length: the one listed first. Without labelled urls
nothing is mined. Repeated rows come back once each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, staged

# fixed values: verdict, host and path beginning
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT, CONFIDENCE, DEFAULT = 0.005, 0.9, "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    rows = only(pages, page_id="page_id", url="url").withColumn("url", F.coalesce("url", F.lit("")))
    return rows.select(
        "page_id",
        F.translate(F.regexp_extract("url", _PARTS, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract("url", _PARTS, 2).alias("path"),
    )


def curated(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(tuple(rules)[::-1], key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Tokens of host and path, at most 9, sorted."""
    labels, dirs = F.split("host", r"\."), F.filter(F.split("path", "/"), lambda x: x != "")
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    named = lambda name, value: F.concat(F.lit(f"{name}="), value)
    last = F.element_at(labels, -1)
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)
    return F.sort_array(
        F.array_compact(
            F.array(
                F.when(F.col("host") != "", named("top", last)),
                F.when(F.size(labels) >= 2, named("site", F.concat_ws(".", F.element_at(labels, -2), last))),
                F.when(F.col("host") != "", named("host", F.col("host"))),
                F.when(F.size(labels) >= 3, named("sub", labels[0])),
                F.when(F.size(dirs) >= 1, named("dir1", shape(dirs[0]))),
                F.when(F.size(dirs) >= 2, named("dir2", shape(dirs[1]))),
                F.when(F.size(dirs) >= 3, named("rest", shape(F.array_join(F.slice(dirs, 3, F.greatest(F.size(dirs), F.lit(1))), "/")))),
                F.when(ext != "", named("ext", F.lower(ext))),
                named("depth", F.size(dirs).cast("string")),
            )
        )
    )


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules antecedent (sorted tokens), verdict, confidence, support from rows tokens, verdict."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("verdict=")))
    rules = rules.select(
        F.sort_array("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 9, 1 << 20).alias("verdict"), "confidence", "support"
    )
    rules = staged(rules, "rules")
    # a rule that is part of another is met under its first token
    part = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("said"), F.col("antecedent")[0].alias("token"))
    whole = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
    inside = (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0)
    redundant = whole.join(part, ["token", "verdict"]).where(inside & (F.col("said") >= F.col("confidence"))).select("antecedent", "verdict").distinct()
    return rules.join(redundant, ["antecedent", "verdict"], "left_anti")


def index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """token -> rule, under the rarest token of each rule."""
    wanted = rules.select(F.explode("antecedent").alias("token")).distinct()
    freq = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    freq = freq.join(F.broadcast(wanted), "token")  # the tokens of the (bounded) rules
    posted = rules.select("*", F.explode("antecedent").alias("token")).join(freq, "token")
    best = posted.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("rare"))
    return best.select(F.col("rare.token").alias("token"), "antecedent", "verdict", "confidence", "support")


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the mined rule that decided, else null)."""
    rule, verdict = curated(rules)
    rows = staged(parts(pages).select("*", rule.alias("rule"), verdict.alias("said"), tokens().alias("tokens")), "urls")
    labelled = rows.where("said is not null").select("tokens", F.col("said").alias("verdict"))
    if labelled.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.lit(DEFAULT).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    lookup = staged(index(mine(labelled, support, confidence), labelled), "rule-index")
    open_sets = rows.where("said is null").select("tokens").distinct()
    hits = open_sets.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(lookup), "token")
    hits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (-F.size("antecedent")).alias("few"), F.array_join("antecedent", " ").alias("mined"), "verdict"))
    decided = staged(hits.groupBy("tokens").agg(best.alias("best")).select("tokens", "best.mined", "best.verdict"), "verdicts")
    out = rows.join(decided, "tokens", "left")
    fits = F.col("said").isNotNull()
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", "verdict", F.lit(DEFAULT)).alias("verdict"),
        F.when(~fits, F.col("mined")).alias("mined"),
    )
