"""Ranked search, hard negatives and token counts against brute force and the library."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavequery.llm import hard_negatives, ranked_search, token_counts
from wavequery.llm.common import exact_products
from wavequery.llm.queries import COUNTED

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    words = [(i, collections.Counter(_terms(t))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    many, total = len(words), sum(sum(c.values()) for _, c in words)
    df = collections.Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in words:
            m = 25 + 75 * sum(c.values()) * many // total
            w = lambda t: math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
            scores.append((-sum(w(t) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in _terms(text) if c[t]), i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k]) if s < 0]
    return out


def _found(spark, docs, items, k=10):
    index = ranked_search.build_index(docs)
    asked = ranked_search.query_terms(spark.createDataFrame(items, "item_id long, text string"))
    return [tuple(r) for r in ranked_search.search(index, asked, k).collect()]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_search_equals_brute_force_over_shards_and_blocks(spark, docs, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(3000)]
    texts += [(10_000 + i, texts[7][1]) for i in range(400)]  # copies: ties
    rng.shuffle(texts)
    items = [(q, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 40)))) for q in range(25)]
    items += [(100, texts[5][1]), (101, "w0 w0 w0"), (102, "nothing known"), (103, ""), (104, None), (100, "w299")]
    got = _found(spark, docs(texts).repartition(3, "doc_id"), items)
    assert _sorted(got) == _sorted(brute_search(texts, items))


def test_search_terms_nulls_ids_long_texts(spark, docs):
    rows = [
        (1, "Tab\tÉté ÉTÉ it's A-b"), (2, None), (3, ""), (4, " .,;"), (None, "tab alpha"), (5, "tab alpha"), (5, "tab alpha"), (6, "x" * 200_000 + " alpha"),
        (7, "alpha " * 70_000 + "omega"), (8, "漢字 かな tab"), (9, "\x00alpha\x7fbeta"),
    ]
    items = [(1, "TAB alpha"), (2, "Été 漢字"), (None, "omega beta omega"), (3, "x" * 200_000), (4, "s A b")]
    assert _sorted(_found(spark, docs(rows, clash=True), items)) == _sorted(brute_search(rows, items))
    assert _found(spark, docs([]), items) == []
    assert _found(spark, docs(rows), []) == []
    assert _found(spark, docs([(1, None), (2, "")]), items) == []


def _one_shard(texts):
    builder = ranked_search._ShardBuilder()
    for i, t in texts:
        builder.add(i, t)
    whole = [r for b in builder.rows(0, 0) for r in b.to_pylist()]
    (about,) = [r for r in whole if r["term"] is None]
    lists = [(r["term"], r["blocks"], r["pairs"], r["postings"]) for r in whole if r["term"]]
    n = np.array(about["lengths"])
    return ranked_search.ShardSearch(about["ids"], n, iter(lists), len(n), int(n.sum())), lists


def test_block_maxima_hold_and_blocks_stay_compressed():
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices([f"w{j}" for j in range(40)], [1 / (j + 1) for j in range(40)], k=rng.randrange(1, 50)))) for i in range(4000)]
    texts[20] = (20, " ".join(["rare1 rare2 rare3"] * 20))
    texts[10] = (10, "rare1 rare2 rare3 w0 w1")
    shard, lists = _one_shard(texts)
    words = {i: collections.Counter(t.split()) for i, t in texts}
    for term, *_ in lists:
        seen = []
        for b in range(len(shard.lists[term].last)):
            docs, tf = shard.lists[term].decompress(b)
            assert tf.tolist() == [words[d][term] for d in docs.tolist()]
            assert docs[-1] == shard.lists[term].last[b]
            assert ranked_search.impact(tf, shard.m[docs]).max() == shard.lists[term].largest[b]
            seen += docs.tolist()
        assert seen == [i for i, c in words.items() if c[term]]
    shard.search([("rare1", 5000), ("rare2", 5000), ("rare3", 5000), ("w0", 10), ("w1", 10), ("w2", 10)], 2)
    every = sum(len(shard.lists[t].last) for t in ("rare1", "rare2", "rare3", "w0", "w1", "w2"))
    assert shard.decompressed < every / 2


def test_search_norms_beyond_64_bits():
    n = np.array([10**9, 5], dtype=np.int64)
    assert ranked_search.norms(n, 10**12, 10**14).tolist() == [25 + 75 * 10**21 // 10**14, 25 + 375 * 10**12 // 10**14]


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, positives=5, negatives=10):
    ok = {(i, lab, tuple(e)) for i, e, lab in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    ints = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for i, lab, e in ok]
    out = []
    for a, label, v in ints:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, lab, w in ints if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(t, n) for t, n, lab in scored if lab != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside)]
    return sorted(out)


def _mined(spark, rows, **more):
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("chunk", F.lit("y")).withColumn("tag", F.lit(1))
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


@pytest.mark.parametrize("chunk", [64, 8192])
def test_hard_negatives_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(1)
    e = np.round(rng.standard_normal((700, 6)) + rng.standard_normal(6), 2)
    rows = [(i, e[i].tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(1000 + i, e[3].tolist(), i % 2) for i in range(120)]  # ties
    rows += rows[:50]  # repeated rows count once
    got = _mined(spark, rows, chunk=chunk)
    assert got == brute_negatives(rows) and len(got) > 100


def test_hard_negatives_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (100, [0.0, 0.0], 1), (200, [], 2), (300, [-1.0, 0.0], 1), (400, [1.0], 3), (1, [1.0, 1.0], 1), (2, [0.5], 2), (3, [0.5, 0.5, 0.5], 2),
        (None, [1.0, 1.0], 2), (4, None, 2), (5, [None, 1.0], 2), (6, [float("nan"), 1.0], 2), (7, [float("inf")], 2), (8, [0.5, 0.4], None), (9, [0.0, 0.0], 2),
        (0, [0.5, 0.5], 2), (10, [2.0, 2.0], 2), (11, [1.0, 0.2], 3), (500, [0.7, 0.7], 9),
    ]
    assert _mined(spark, rows) == brute_negatives(rows)
    assert _mined(spark, []) == []
    assert _mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_hard_negatives_large_components_exact_or_refused(spark):
    big = [(0, [3e6, 1.0], 1), (1, [2e6, 3.0], 1), (2, [1e6, 5.0], 2), (3, [0.9e6, 7.0], 2)]
    assert _mined(spark, big) == brute_negatives(big) != []
    with pytest.raises(Exception, match="does not fit 64 bits"):
        _mined(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [1.0], 2)])
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**22, 5.0], [2.0**14, 1.0]])
    assert exact_products(a, b).tolist() == [[2**62 + 15, 2**54 + 3]]


ODD = [
    None, "", " ", "  ", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|>", "it's 3 o'clock\n\n we'll go", "\x1c\x85\xa0 x", "漢字 かな 🙂🙂 é ՘a ࢏", "tab\t\tnext  two ",
    " lead", "trail ", "a\n b", "word " * 30_000, "x" * 50_000, "1234567890" * 3000,
]


def test_token_counts_equal_library(docs):
    rng = random.Random(2)
    letters = " \n\t\x1c\x85\xa0aAbZéñß'sllre1239½²!?.,漢かな🙂‍՘́　"
    texts = ODD + ["".join(rng.choice([rng.choice(letters), "the", " and", "<|endoftext|>", "  ", "ing"]) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    rows = [(i % 2900, t) for i, t in enumerate(texts)] + [(None, "no id")]
    tok = Tokenizer.from_file(COUNTED)
    want = collections.Counter()
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    got = token_counts.token_counts(docs(rows, clash=True), COUNTED).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert token_counts.token_counts(docs([]), COUNTED).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000 + "y", "\n" * 1_000_000, "a" * 1_000_000, "ab" * 300_000])
def test_token_counts_of_very_long_pieces(text):
    tok = Tokenizer.from_file(COUNTED)
    assert token_counts.count_text(text, COUNTED) == len(tok.encode(text, add_special_tokens=False).ids)


def test_token_counts_refuse_other_vocabularies():
    with pytest.raises(ValueError):
        token_counts.count_text("x", P.path("word_bpe_49k.json"))
