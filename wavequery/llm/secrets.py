"""Secret scans with a trigram inverted index; DataFrame functions only.

Each rule's pattern is reduced to a Boolean query on trigrams: alternatives (OR) of trigrams that any
match must hold (AND). The index lists, for every trigram that some query asks for, the documents
whose lower-cased text has it. Postings are intersected per alternative; documents that satisfy one are
candidates, and only they are searched with the pattern. A rule with an alternative that has
no trigram scans every document.

Spans are positions of whole matches in code points, end exclusive; matches of one rule are leftmost and do
not overlap. A match that is too short is dropped without another try inside it. Null text counts as empty. Rows with
a null id are not in the index and are searched by every rule. Several rows of one id share its postings (a superset of each row's), so each row's
spans are its own. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, staged

# Candidates are (id, rules) rows of at most 200 bytes each, all rules' names included; a table of up to this many rows (under 64 MB) is
# broadcast, a larger one is joined by shuffling.
BROADCAST_ROWS = 300_000


@dataclass(frozen=True)
class Rule:
    """``minimum``: code points that ``group`` must have. ``plain``: the same pattern for engines without look-around and possessive
    repeats; where it has a group, that is the span, at the match's end."""

    kind: str
    pattern: str
    group: int = 0
    minimum: int = 0
    plain: str | None = None


# fixed values: the base rules and their patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
BASE = (Rule("assign", ASSIGN, 2, 12), Rule("access", ACCESS, 0, 18), Rule("hex", HEX, 0, 16))
_KEY = "[A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
# a key runs to its END line, with no other line of five dashes between; without one, over the header lines and
# the base64 that follow (and on to the next character that cannot be of a key); else it is the BEGIN line alone
# whatever the number of lines and dashes; possessive repeats, so that a search takes one pass and no stack
_TO_END = rf"(?:(?!-----)[\s\S])*+-----END {_KEY}"
_HEADER, _BASE64 = r"[>\\nr\x20\t\r\n]*[A-Z][A-Za-z-]*:[^\r\n]*", r"[>\\nr\x20\t\r\n]*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=>\\\x20\t\r\n]*"
_LINES = f"(?:{_HEADER}[\\r\\n])*"
PRIVATE_KEY = f"-----BEGIN {_KEY}(?:{_TO_END}|{_LINES}+(?:{_HEADER})?{_BASE64}|(?:{_HEADER})?{_BASE64})?"
# this one also takes in base64 of a later header's value where no body follows
_PRIVATE_KEY = f"-----BEGIN {_KEY}(?:(?:[^-]|-{{1,4}}[^-])*-----END {_KEY}|{_LINES}(?:{_HEADER})?{_BASE64})?"
# a token starts where no character of one stands before, so that a run of them is searched once
_PART = "[A-Za-z0-9_-]{8,}"
JWT = rf"(?<![A-Za-z0-9_-])eyJ{_PART}+\.eyJ{_PART}+\.{_PART}"
_JWT = rf"(?:^|[^A-Za-z0-9_-])(eyJ{_PART}\.eyJ{_PART}\.{_PART})"
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", JWT, plain=_JWT),
    Rule("private_key", PRIVATE_KEY, plain=_PRIVATE_KEY),
)
RULES = BASE + MORE

_MANY = 64


def _alternatives(tokens) -> list[list[str]]:
    """What a match holds, as alternatives; each is a list of literal runs with gaps of any text between them."""
    out: list[list[str]] = [[""]]
    gap = [["", ""]]
    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            got = [[chr(arg).lower()]]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            got = [[c] for c in sorted({chr(x).lower() for _, x in arg})]
        elif name == "SUBPATTERN":
            got = _alternatives(arg[3])
        elif name == "BRANCH":
            got = [alt for branch in arg[1] for alt in _alternatives(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            once = _alternatives(inner)
            if low == 0 and high == 1 and len(once) <= 8:
                got = [[""], *once]
            elif low == 0:
                got = gap
            else:
                got = [[""]]
                for _ in range(min(low, 4)):
                    got = _joined(got, once)
                if not (low == high <= 4):
                    got = _joined(got, gap)
        elif name == "AT":
            got = [[""]]
        else:
            got = gap
        out = _joined(out, got)
    return out


def _joined(left: list[list[str]], right: list[list[str]]) -> list[list[str]]:
    if len(left) * len(right) > _MANY:  # too many to spell out: go on with what is certain
        left, right = (left, [["", ""]]) if len(left) <= _MANY else ([["", ""]], right)
    return [[*a[:-1], a[-1] + b[0], *b[1:]] for a in left for b in right]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams, one of which any match satisfies in lower case; None: no index can help."""
    out = set()
    for runs in _alternatives(sre.parse(pattern)):
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        out.add(grams)
    return sorted((q for q in out if not any(p < q for p in out)), key=sorted)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that queries ask for."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    # the lower-cased text is bound once per row, outside the loop over trigrams
    have = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", have.alias("have"))
    return rows.where(F.size("have") > 0).select(F.explode("have").alias("trigram"), "doc_id").distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the indexed rules whose query a document's postings satisfy."""
    spark = index.sparkSession
    asked = [(r.kind, k, len(q), t) for r in rules for k, q in enumerate(trigram_query(r.pattern) or []) for t in sorted(q)]
    # one row per rule, alternative and trigram: bounded by the rules
    asked_df = spark.createDataFrame(asked, "kind string, alternative int, needs int, trigram string")
    met = index.join(F.broadcast(asked_df), "trigram").groupBy("doc_id", "kind", "alternative", "needs").agg(F.count("*").alias("n"))
    return met.where("n = needs").groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _spans(rule: Rule, order: int) -> Column:
    """array<struct<start, rank, end, kind>> of one rule, from the column ``text``."""
    pattern = rule.pattern
    if rule.group == 0 and rule.minimum:
        # a run of one class: the runs that are long enough are the same, without a list of the short ones
        run = {HEX: f"[0-9a-f]{{{rule.minimum},}}", ACCESS: f"AKIA[A-Z0-9]{{{rule.minimum - 4},}}"}
        pattern = run.get(pattern, pattern)
    text, rx = F.col("text"), F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    sizes = F.transform(found, F.length)
    kept = F.transform(F.regexp_extract_all(text, rx, F.lit(rule.group)), F.length) if rule.group else sizes
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # (end so far, spans): a gap, then a match; the text after the last match has no size
    struct = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.coalesce(s["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        hit = s["size"].isNotNull() & (s["kept"] >= rule.minimum)
        return F.struct(end.alias("at"), F.when(hit, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(struct).alias("spans"))
    walked = F.aggregate(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), kept.alias("kept")), empty, add, lambda a: a["spans"])
    return F.when(F.regexp_like(text, rx), walked).otherwise(F.array().cast(struct))


def scan(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns ``keep`` under the names c0, c1, ..., with text (never null) and
    found: array<struct<start, rank, end, kind>> by start and rule."""
    rows = only(docs, **{f"c{i}": c for i, c in enumerate(keep)}, doc_id="doc_id", text="text")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for alt in q or () for t in alt})
    if trigrams:
        index = staged(build_index(rows, trigrams), "trigrams")
        hits = staged(candidates(index, rules).withColumnRenamed("doc_id", "_id"), "candidates")
        small = hits.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(hits) if small else hits, rows["doc_id"] == hits["_id"], "left").drop("_id")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for i, r in enumerate(rules):
        spans = _spans(r, i)
        if queries[r.kind] is not None:
            due = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
            spans = F.when(due, spans).otherwise(none)
        parts.append(spans)
    return rows.select(*[f"c{i}" for i in range(len(keep))], "text", F.sort_array(F.concat(*parts)).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base rule, a digest of the base spans, and all spans."""
    found = scan(docs, ["doc_id"], rules)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(
        F.col("c0").alias("doc_id"), *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The columns of ``docs``, with each stretch of text that spans cover replaced by ``mark`` and ``n_chars``
    (if there) counted anew; texts without a span, null ones too, stay as they are."""
    cols = docs.columns
    found = scan(docs, cols, rules)
    body = F.expr(
        "aggregate(found, struct(0 as at, '' as out), (acc, s) -> struct(greatest(acc.at, s.end) as at, "
        f"if(s.start >= acc.at, concat(acc.out, substring(text, acc.at + 1, s.start - acc.at), '{mark}'), acc.out) as out), "
        "acc -> concat(acc.out, substring(text, acc.at + 1)))"
    )
    hit = F.size("found") > 0
    out = found.withColumn("body", body)
    new = {"text": F.col("body"), "n_chars": F.length("body").cast("long")}
    return out.select(
        *[F.when(hit, new[c]).otherwise(F.col(f"c{i}")).alias(c) if c in new else F.col(f"c{i}").alias(c) for i, c in enumerate(cols)]
    )
