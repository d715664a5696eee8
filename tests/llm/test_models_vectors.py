"""Language ID, toxicity, vector search and near-duplicates, WARC, URL rules, pipeline."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavequery.llm import embeddings, langid, maxscore, toxicity, urlfilter, warc
from wavequery.llm.common import staging_path, table

SF = "/root/testdata/sf0.01"


def test_langid_backs_off_and_rejects(docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 20)]
    model = langid.fit(docs(rows + [(None, "x", "en"), (99, None, "de"), (98, "y", None)]))
    assert model.langs == ["de", "en"] and "hund" in model.words
    assert np.argmax(model.word("hunde")) == 0 and np.argmax(model.word("thee")) == 1  # unseen words
    ask = docs([(1, None), (2, ""), (3, "123 ²² !!"), (4, "Der HUND"), (5, "the mat " * 30000), (None, "cat"), (4, "Der HUND")], clash=True)
    got = sorted(map(tuple, langid.predict(ask, model).collect()), key=repr)
    assert {(r[0], r[1]) for r in got} == {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (None, "en")} and len(got) == 7
    assert all(0 <= r[2] <= 1 for r in got)
    empty = langid.fit(docs([]))
    assert [tuple(r)[1:] for r in langid.predict(docs([(1, "text")]), empty).collect()] == [("und", 0.0)]
    assert langid.predict(docs([]), model).count() == 0


def test_langid_held_out_accuracy(spark):
    d = table(spark, SF, "documents")
    model = langid.fit(d.where(langid.training_rows()))
    held = langid.predict(d.where(~langid.training_rows()), model, keep=["doc_id", "lang"])
    assert held.where("lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_pu_risk_is_never_negative():
    zp, zu = np.array([3.0, 5.0]), np.array([-9.0, -8.0])
    risk, gp, gu = toxicity.pu_risk_gradient(zp, zu, 0.5)
    assert risk >= 0 and (gp <= 0).all() and not gu.any()
    eps, zu = 1e-6, np.array([1.0, -2.0, 0.5])
    base, gp, gu = toxicity.pu_risk_gradient(np.array([0.1, -0.4]), zu, 0.2)
    up = toxicity.pu_risk_gradient(np.array([0.1 + eps, -0.4]), zu, 0.2)[0]
    assert abs((up - base) / eps - gp[0]) < 1e-4


def test_toxicity_learns_and_handles_odd_rows(spark, docs):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = [(i, " ".join(word() for _ in range(20)) + (" nastyword" if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    df = docs(rows + [(None, "nastyword"), (1000, None), (1001, "")], clash=True)
    model = toxicity.fit(df, labels, F.lit(True))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in range(300, 400))
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[1000]["score"] == got[1001]["score"]
    none = toxicity.fit(df, labels.where("toxic = 0"), F.lit(True))
    assert toxicity.score(df, none).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(docs([]), model).count() == 0


def _texts(n, word, seed):
    """Featurised texts of 20 random words, with ``word`` if given."""
    rng = np.random.default_rng(seed)
    texts = (" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(20)) for _ in range(n))
    return [toxicity.text_features(f"{t} {word or ''}") for t in texts]


def test_toxicity_learns_the_words_of_one_percent_of_the_positives():
    rare, common = _texts(10, "schimpf", 1), _texts(990, "nastyword", 2)
    clean = _texts(1800, None, 3)
    ids, weights, bias = toxicity.train(common + rare, clean + common[:198] + rare[:2], 0.1)
    weight = dict(zip(ids.tolist(), weights.tolist()))
    logit = lambda x: bias + sum(weight.get(f, 0.0) for f in x.tolist())
    assert all(logit(x) > 0 for x in _texts(20, "schimpf", 4) + _texts(20, "nastyword", 5))
    assert sum(logit(x) > 0 for x in _texts(200, None, 6)) <= 4


def test_toxicity_is_not_moved_by_copies_of_a_clean_text(spark, docs):
    rng = np.random.default_rng(7)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(20))
    rows = [(i, text() + (" nastyword" if i % 2 else "")) for i in range(400)]
    copies = [(1000 + i, "one clean text again and again") for i in range(400)]
    df = docs(rows + copies)
    labels = spark.createDataFrame([(r[0], r[0] % 2 if r[0] < 1000 else 0) for r in rows[:300] + copies], "doc_id long, toxic int")
    once = labels.where("doc_id < 1001")
    model, same = toxicity.fit(df, labels, F.lit(True)), toxicity.fit(docs(rows + copies[:1]), once, F.lit(True))
    assert model.weights and model == same
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model).collect()}
    assert all(got[i] == (i % 2 if i < 1000 else 0) for i in got)


def test_toxicity_keeps_features_where_most_texts_are_toxic():
    ids, _, _ = toxicity.train(_texts(300, "nastyword", 8), _texts(300, None, 9) + _texts(800, "nastyword", 10), 0.3)
    assert set(toxicity.word_features("nastyword")) <= set(ids.tolist())


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, `key` string")


def _odd_vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16)).astype(np.float32)
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.standard_normal(16).astype(np.float32) * (0.05 if i % 3 else 0.6)
        rows.append((i, v.astype(np.float32).tolist(), i % 2, "x", "y"))
    rows += [(200 + i, rows[0][1], 0, "x", "y") for i in range(30)]
    bad = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(300 + i, b, 0, "x", "y") for i, b in enumerate(bad)]
    return rows + [(400, rows[0][1], None, "x", "y"), (401, rows[0][1][:8], 0, "x", "y"), (5, rows[5][1], 1, "x", "y")]


@pytest.mark.parametrize("block", [1024, 4])
def test_embeddings_against_brute_force(spark, block):
    rows = _odd_vectors()
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, root = {id(r): [] for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[id(a)].append(b[0])
                    links[id(b)].append(a[0])
                    p, q = sorted((find(a[0]), find(b[0])))
                    root[q] = p
    want = sorted((r[0], len(links[id(r)]), find(r[0]), r[0] == find(r[0])) for r in rows)
    assert sorted(map(tuple, embeddings.near_duplicates(_vectors(spark, rows), block=block).collect())) == want
    assert embeddings.near_duplicates(_vectors(spark, [])).count() == 0


def test_hashing_meets_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    x, y = embeddings.unit(rng.standard_normal((2000, 64))), rng.standard_normal((2000, 64))
    y = embeddings.unit(y - (x * y).sum(1, keepdims=True) * x)
    z = 0.93 * x + math.sqrt(1 - 0.93**2) * y
    args = (embeddings.TABLES, embeddings.HASHES, embeddings.WIDTH, embeddings.SEED)
    met = (embeddings.bucket_keys(x, *args) == embeddings.bucket_keys(z, *args)).any(axis=1)
    assert met.mean() > 0.99


@pytest.mark.parametrize("shard,queries", [(8192, 2048), (25, 4)])
def test_maxscore_against_brute_force(spark, shard, queries):
    rows = _odd_vectors()
    ints = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    want = []
    for q in sorted({i for i, _ in ints if i % 5 == 0}):
        best = {}
        for qi, qv in ints:
            for i, v in ints:
                if qi == q and i != q:
                    best[i] = max(best.get(i, -(1 << 60)), sum(a * b for a, b in zip(qv, v)))
        want += [(q, k + 1, i, s) for k, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    got = maxscore.search(_vectors(spark, rows), F.col("vec_id") % 5 == 0, shard=shard, queries=queries)
    assert sorted(map(tuple, got.collect())) == want
    assert maxscore.search(_vectors(spark, []), F.col("vec_id") % 5 == 0).count() == 0


def test_maxscore_with_large_weights():
    rng = np.random.default_rng(7)
    x = rng.integers(-(1 << 28), 1 << 28, (500, 6))
    ids, scores = maxscore.Shard(np.arange(500), x).search(3, x[3], 5)
    want = sorted(((-int(a), i) for i, a in enumerate((x @ x[3]).tolist()) if i != 3))[:5]
    assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == want


PAGES = "page_id long, url string, html string, shard int, payload string"


def test_warc_round_trip_and_layout(spark):
    big, small = "<p>é" * 600, "tiny"
    rows = [(1, "http://a/\n x", big, 0, "z"), (7, None, big, 0, "z"), (3, "http://b/é", big, 0, "z"), (4, "u", small, 0, "z"), (5, "u", small, 0, "z"), (6, "u", None, 0, "z"), (None, "u", big, 0, "z"), (8, "u", "", 0, "z"), (7, "u2", big, 0, "z"), (9, "u", "x" * 400000, 0, "z")]
    pages = spark.createDataFrame(rows, PAGES)
    uris = [staging_path(spark, "warc-test") for _ in range(2)]
    manifests = [sorted(map(tuple, warc.write(p, u, shard_bytes=3000, roll_bytes=600).collect())) for p, u in zip((pages, pages.repartition(5)), uris)]
    assert manifests[0] == manifests[1] and len(manifests[0]) > 2  # the same bytes from any input order
    back = warc.read(warc.write(pages, uri := staging_path(spark, "warc-test")), uri).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in back), key=repr)
    want = [(p, len((h or "").encode()), "revisit" if h == big and p != 7 else "response", 7 if h == big and p != 7 else None) for p, _, h, *_ in rows]
    assert got == sorted(want, key=repr)
    assert {r["payload"] for r in back if r["page_id"] == 7} == {big.encode()}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_shards_stay_small_on_skewed_ids(spark):
    """A third of the rows without an id, a third one repeated row, and ids at both ends of the range."""
    rows = [(None, f"u{i}", f"{i:04d}" * 150, 0, "z") for i in range(300)] + [(7, "u", "y" * 600, 0, "z")] * 300
    rows += [(i, f"u{i}", "x" * 600, 0, "z") for i in range(1000, 1300)] + [(2**63 - 1, "a", "b", 0, "z"), (-(2**63), "a", "b", 0, "z")]
    uri = staging_path(spark, "warc-test")
    manifest = warc.write(spark.createDataFrame(rows, PAGES), uri, shard_bytes=50_000, roll_bytes=1 << 30)
    sizes = [r["payload_bytes"] for r in manifest.collect()]
    assert len(sizes) >= 18 and max(sizes) <= 2 * 50_000
    back = [(r["page_id"], r["url"], r["payload_bytes"]) for r in warc.read(manifest, uri).collect()]
    assert sorted(back, key=repr) == sorted(((p, u, len(h)) for p, u, h, *_ in rows), key=repr)


def test_warc_reader_refuses_changed_files(spark):
    pages = spark.createDataFrame([(1, "u", "hello", 0, "z")], PAGES)
    manifest = warc.write(pages, uri := staging_path(spark, "warc-test"))
    with pytest.raises(Exception, match="not what the manifest lists"):
        warc.read(manifest.withColumn("sha256", F.lit("0")), uri).collect()


def test_url_parts_and_rules(spark):
    urls = ["HTTP://Www.Example.ORG/es/x?q#f", "https://example.org/en/12", "x://sub.example.org/en/2", "http://fr.com/fr/", "no scheme org/", None, "http://org", "http://a.com/de/?x", "http://notexample.org/es/", "a://b://c/d", "http://É.ORG/x"]
    df = spark.createDataFrame([(i, u, None, i, "p") for i, u in enumerate(urls)] + [(0, urls[0], None, 0, "p")], "page_id long, url string, html string, rule int, host string").select("page_id", "url", "rule")
    rows = urlfilter.judge(df).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in rows}
    assert got == {
        0: ("www.example.org", "/es/x", "example.org/es/"), 1: ("example.org", "/en/12", "example.org/en/1"), 2: ("sub.example.org", "/en/2", "org/"), 3: ("fr.com", "/fr/", "com/fr/"),
        4: ("", "", None), 5: ("", "", None), 6: ("org", "", None), 7: ("a.com", "/de/", "com/de/"), 8: ("notexample.org", "/es/", "org/"), 9: ("b:", "//c/d", None), 10: ("É.org", "/x", "org/"),
    }
    verdicts = {r["page_id"]: r["verdict"] for r in rows}
    assert (verdicts[0], verdicts[1], verdicts[2], verdicts[7]) == ("block", "block", "allow", "block")
    assert urlfilter.judge(df.where("false")).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(df.where("page_id in (4, 5)")).collect()} == {"allow"}


def test_mined_rules_are_pruned_and_judge_open_urls(spark):
    rows = [(i, f"http://h{i % 7}.example.org/{'es' if i % 2 else 'fr'}/{i}", None) for i in range(400)]
    rows += [(1000 + i, f"http://x{i}.example.net/{'es' if i % 2 else 'fr'}/9", None) for i in range(20)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id >= 1000").collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") and r["mined"] == f"dir1={'es' if r['page_id'] % 2 else 'fr'}" for r in got)


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    from wavequery.llm.common import staged

    docs = table(spark, SF, "documents")
    before = docs
    for name, stage in C.STAGES[:-1]:
        after = staged(stage(spark, before, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        if name == "near_duplicates":
            from wavequery.llm import simhash

            found = simhash.near_duplicates(before)
            assert after.count() == found.select("component_id").distinct().count()
        before = after
    packed = C.STAGES[-1][1](spark, before, SF)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert whole.where("n <> m").count() == 0 and whole.count() == before.count()
    empty = docs.where("false")
    for _, stage in C.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as E
    from wavequery.llm.queries import ORACLE

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for key, sql in ORACLE.items():
        df = E.queries()[key](spark, "/root/testdata/sf0.001")
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr), key


def test_long_groups_cross_batches():
    from wavequery.llm.common import multi_groups

    keys = [1, 2, 2, 3, 3, 3, 4, 5, 5]
    batches = [pa.record_batch([pa.array(keys[i : i + 2]), pa.array(list(range(i, i + len(keys[i : i + 2]))))], names=["k", "v"]) for i in range(0, 9, 2)]
    assert [g.column("v").to_pylist() for g in multi_groups(batches, ["k"])] == [[1, 2], [3, 4, 5], [7, 8]]


def test_maxscore_refuses_products_beyond_64_bits(spark):
    ask = lambda big: maxscore.search(_vectors(spark, [(0, [big, 1.0], 1, "", ""), (1, [big, 2.0], 1, "", ""), (2, [1.0], 1, "", "")]), F.col("vec_id") == 0)
    for big in (2e7, 2e8, 1e30):
        with pytest.raises(OverflowError):
            ask(big)
    near = float(np.float32(1.0e6))
    assert [r.score for r in ask(near).collect()] == [int(256 * near) ** 2 + 256 * 512, int(256 * near) * 256]
    assert maxscore.search(_vectors(spark, [(0, [], 1, "", ""), (1, [], 1, "", "")]), F.col("vec_id") == 0).collect()[0].score == 0


def test_language_words_and_ngrams_are_kept_beside_a_large_language(docs):
    large = [(i, " ".join(f"gro{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(i * 300, i * 300 + 300)), "big") for i in range(40)]
    small = [(1000, "ixquo zemblat", "few"), (1001, "vrakul", "few")]
    model = langid.fit(docs(large + small))
    assert {"ixquo", "zemblat", "vrakul", "groaaa"} <= set(model.words) and len(model.words) == 40 * 300 + 3
    assert any("embla" in table for table in model.grams)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs([(1, "zemblat"), (2, "vraku"), (3, "embla"), (4, "grobaa")]), model).collect()}
    assert got == {1: "few", 2: "few", 3: "few", 4: "big"}


def test_a_rule_of_four_tokens_and_a_third_directory_decide(spark):
    import itertools

    rules = (("block", "s1.k.net", "/b/b/b/"), ("allow", "net", "/"))
    rows = [(100 * k + i, f"http://s{s}.k.net/{'ab'[x]}/{'ab'[y]}/{'ab'[z]}/") for k, (s, x, y, z) in enumerate(itertools.product((0, 1), repeat=4)) for i in range(40)]
    rows += [(9000 + k, f"http://s{s}.k.dev/{'ab'[x]}/{'ab'[y]}/{'ab'[z]}/") for k, (s, x, y, z) in enumerate(itertools.product((0, 1), repeat=4))]
    rows += [(9100, "http://s1.k.dev/b/b/b/" + "d/" * 20_000), (9101, "x" * 500_000), (9102, "http://" + "l." * 20_000 + "dev/" + "y" * 200_000)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got[9015].verdict == "block" and got[9015].mined == "dir1=b dir2=b rest=b sub=s1"
    assert all(got[9000 + k].verdict == "allow" and got[9000 + k].mined for k in range(15))
    assert all(got[k].verdict == "allow" for k in (9100, 9101, 9102)) and len(got) == len(rows)


def _plain_language(model, text):
    """The model's rule restated word by word, without caches or matrices."""
    import re

    total, n = [0.0] * len(model.langs), 0
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        if not any(c.isalpha() for c in word):
            continue
        n += 1
        if word in model.words:
            rows = [model.words[word]]
        else:
            rows = []
            for order, table_ in zip(langid.ORDERS, model.grams):
                padded = f" {word} "
                rows = [table_[padded[k : k + order]] for k in range(len(padded) - order + 1) if padded[k : k + order] in table_]
                if rows:
                    break
        for k in range(len(total)):
            total[k] += sum(float(model.evidence[r][k]) for r in rows) / len(rows) if rows else 0.0
    if not n:
        return "und", 0.0
    best = max(range(len(total)), key=lambda k: (total[k], -k))
    return model.langs[best], 1 / sum(math.exp((t - total[best]) / n * min(n, langid.EVIDENCE)) for t in total)


def test_languages_equal_a_plain_scorer(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit(d.where(langid.training_rows()))
    got = langid.predict(d, model, keep=["doc_id", "text"]).collect()
    assert len(got) == d.count()
    for r in got:
        lang, score = _plain_language(model, r.text)
        assert lang == r.lang_pred and math.isclose(score, r.score, rel_tol=1e-6, abs_tol=1e-9)


def test_toxicity_equals_a_plain_scorer_and_finds_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(d, labels, toxicity.training_rows())
    held = toxicity.score(d.where(~toxicity.training_rows()), model, keep=["doc_id", "text"])
    rows = held.join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    hits = {0: [0, 0], 1: [0, 0]}
    for r in rows:
        z = model.bias + sum(model.weights.get(f, 0.0) for f in set(toxicity.text_features(r.text).tolist()))
        plain = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert math.isclose(plain, r.score, rel_tol=1e-9, abs_tol=1e-12) and r.predicted == int(r.score >= 0.5)
        if r.toxic is not None:
            hits[r.toxic][r.predicted] += 1
    assert hits[1][1] / sum(hits[1]) > 0.75 and hits[0][1] / sum(hits[0]) < 0.06
