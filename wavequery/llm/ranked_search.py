"""Ranked lexical search by Block-Max MaxScore over document shards.

Index. Documents are taken in shards of bounded size as they are read. A shard has a posting list per term, in blocks of 128
postings: gaps between documents and term counts, each in the fewest bytes that hold the block's largest. For every block the index has the
last document, and those pairs (term count, document length) that no other pair of the block beats, so that the block's largest
score is known for any corpus statistics without decompression. The index is one table, a row per shard and term.

Search. The postings of the queries' terms and all queries meet once per shard. A query's lists are ordered by their largest
score; the best blocks of the first ones give a threshold that k documents reach. Windows of documents are taken in order; lists whose bounds together stay below the k-th best score so far
are non-essential. Essential lists are traversed. The documents found there are held against the global bounds of the
non-essential lists, then against the maxima of the blocks they would be in, and only blocks that some document still needs
are decompressed. Shards return k rows a query, which are merged.

A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. With N documents that
have a term, L terms in all, n in a document and df documents with the term: w = floor(1000 ln((2N + 2) / (2df + 1))),
m = 25 + (75 n N) div L, score = sum of w * ((10**9 tf) div (1000 tf + 8 m)) over the query's terms, repeats included, in 64-bit integers.

Null and empty texts have no term and are never found; texts of any length are indexed whole (a long one may fill a shard). A query of no known term has no
rows, and none is found by terms of weight 0 alone. Equal scores go to the smaller id, a null id last. Rows that share an id, or are repeated, are documents
(and queries) each of their own. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import only, staged

TOP = 10
BLOCK = 128  # postings of a block
DOCUMENTS, BYTES = 8192, 16 << 20  # a shard is closed at so many documents or bytes of text
FIRST_WINDOW, LAST_WINDOW = 256, 4096  # documents of the first window of a search; windows double up to the last
_ROWS = 10_000  # lists of an Arrow batch
_TASKS = 20_000  # search tasks, at most; a shard each where there are fewer
_HEADS = 4  # lists whose best blocks give the first threshold
# a term holds ASCII letters and digits and any byte of a character beyond ASCII; the rest parts terms
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_BLOCKS = np.dtype([("last", "<u4"), ("at", "<u4"), ("count", "u1"), ("gap", "u1"), ("tf", "u1"), ("pairs", "<u2")])
_PAIRS = np.dtype([("tf", "<u4"), ("n", "<u4")])
_INDEX = "part int, shard int, term string, df long, blocks binary, pairs binary, postings binary, ids array<long>, lengths array<long>"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TO_TERMS).split()


def _bytes_of(v: np.ndarray) -> np.ndarray:
    """1, 2 or 4: the bytes that hold each value."""
    return np.where(v < 1 << 8, 1, np.where(v < 1 << 16, 2, 4))


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(change)
    return starts, np.diff(np.append(starts, len(change)))


class _ShardBuilder:
    """Term numbers of the documents read so far."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found = terms(text)
        if found:
            self.ids.append(doc_id)
            self.words.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found)))
            self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= DOCUMENTS or self.bytes >= BYTES

    def rows(self, part: int, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's lists, then a row of its documents."""
        if not self.ids:
            return
        n = np.array([len(w) for w in self.words])
        docs = len(n)
        key = np.concatenate(self.words, dtype=np.int64)
        self.words = []
        key *= docs
        key += np.repeat(np.arange(docs), n)
        key.sort()
        at, tf = _runs(np.concatenate([[True], key[1:] != key[:-1]]))
        term, doc = np.divmod(key[at], docs)
        del key
        first, df = _runs(np.concatenate([[True], term[1:] != term[:-1]]))
        place = np.arange(len(term)) - np.repeat(first, df)  # of a posting in its list
        head = place % BLOCK == 0
        block = np.cumsum(head) - 1
        starts, count = _runs(head)
        gap = np.diff(doc, prepend=0)
        gap[head] = doc[head]
        gap_bytes, tf_bytes = _bytes_of(np.maximum.reduceat(gap, starts)), _bytes_of(np.maximum.reduceat(tf, starts))
        # gaps of a block, then its term counts
        sizes = count * (gap_bytes + tf_bytes)
        begin = np.cumsum(sizes) - sizes
        data = np.zeros(int(sizes.sum()), dtype=np.uint8)
        within = place % BLOCK
        for values, width, base in ((gap, gap_bytes, begin), (tf, tf_bytes, begin + count * gap_bytes)):
            to, size = base[block] + within * width[block], width[block]
            for k in range(4):
                more = size > k
                data[to[more] + k] = (values[more] >> (8 * k)) & 255
        # pairs of a block that no other beats: by falling term count, each shorter than all before
        long = n[doc]
        order = np.lexsort((long, -tf, block))
        level = long[order] - block[order] * (int(n.max()) + 1)
        before = np.minimum.accumulate(level)
        best = np.concatenate([[True], level[1:] < before[:-1]])
        picked = order[best]
        pairs = np.zeros(len(picked), dtype=_PAIRS)
        pairs["tf"], pairs["n"] = tf[picked], long[picked]
        table = np.zeros(len(starts), dtype=_BLOCKS)
        ends = starts + count - 1
        table["last"], table["count"], table["gap"], table["tf"] = doc[ends], count - 1, gap_bytes, tf_bytes
        table["pairs"] = np.bincount(block[picked], minlength=len(starts))
        of_list = block[first]  # the first block of each list
        blocks_end = np.append(of_list[1:], len(starts))
        data_end = np.append(begin, len(data))
        table["at"] = begin - np.repeat(begin[of_list], blocks_end - of_list)
        pairs_end = np.concatenate([[0], np.cumsum(table["pairs"], dtype=np.int64)])
        del gap, within, place, level, order, before, best, picked
        names = list(self.vocabulary)
        table_bytes, pair_bytes, data_bytes = table.tobytes(), pairs.tobytes(), data.tobytes()
        many = len(first)
        for lo in range(0, many, _ROWS):
            hi = min(many, lo + _ROWS)

            def cut(whole: bytes, ends: np.ndarray, size: int) -> pa.Array:
                parts = zip(ends[of_list[lo:hi]].tolist(), ends[blocks_end[lo:hi]].tolist())
                return pa.array([whole[a * size : b * size] for a, b in parts], pa.binary())

            none = pa.nulls(hi - lo, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * (hi - lo), pa.int32()), "shard": pa.array([shard] * (hi - lo), pa.int32()),
                    "term": pa.array([names[t].decode() for t in term[first[lo:hi]].tolist()], pa.string()), "df": pa.array(df[lo:hi], pa.int64()),
                    "blocks": cut(table_bytes, np.arange(len(starts) + 1), _BLOCKS.itemsize), "pairs": cut(pair_bytes, pairs_end, _PAIRS.itemsize),
                    "postings": cut(data_bytes, data_end, 1), "ids": none, "lengths": none,
                }
            )
        kinds = {"part": pa.int32(), "shard": pa.int32(), "term": pa.string(), "df": pa.int64(), "blocks": pa.binary(), "pairs": pa.binary(), "postings": pa.binary()}
        kinds |= {"ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}
        whole = dict.fromkeys(kinds, [None]) | {"part": [part], "shard": [shard], "ids": [self.ids], "lengths": [n.tolist()]}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in whole.items()})


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index table, staged: a row per (shard, term), and per shard one of no term with its documents' ids and lengths.
    A shard is named by the partition that it was read in and its number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, builder, part = 0, _ShardBuilder(), TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                builder.add(doc_id, text.as_py() or "")
                if builder.full():
                    yield from builder.rows(part, made)
                    made, builder = made + 1, _ShardBuilder()
        yield from builder.rows(part, made)

    rows = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("text is not null")
    return staged(rows.mapInArrow(run, _INDEX), "index")


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """query (a number of its own), item_id, term, times: a row per distinct term of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = zip(*(batch.column(i).to_pylist() for i in range(3)))
            out = [(query, item, term.decode(), times) for query, item, text in numbered for term, times in Counter(terms(text)).items()]
            cols = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["query", "item_id", "term", "times"])

    rows = staged(only(queries, item_id=id_col, text=text_col).where("text is not null"), "queries")
    rows = rows.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), "text")
    return staged(rows.mapInArrow(run, "query long, item_id long, term string, times long"), "query-terms")


def weight(df: Column, documents: int) -> Column:
    """floor(1000 ln((2N + 2) / (2df + 1))), in doubles."""
    return F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * documents + 2) / (df * 2 + 1).cast("double"))).cast("long")


def norms(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with so many terms."""
    if int(lengths.max(initial=0)) * documents * 75 < 2**63:
        return 25 + 75 * documents * lengths.astype(np.int64) // total
    return np.array([25 + 75 * documents * n // total for n in lengths.tolist()], dtype=np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 8 * m)


@dataclass
class Postings:
    """One list of a shard: block table, the largest impact of each block, compressed postings."""

    last: np.ndarray
    largest: np.ndarray
    blocks: np.ndarray
    data: bytes

    def decompress(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and term counts of one block."""
        at, gap, tf, count = (int(self.blocks[b][f]) for f in ("at", "gap", "tf", "count"))
        docs = np.frombuffer(self.data, f"<u{gap}", count + 1, at).astype(np.int64).cumsum()
        return docs, np.frombuffer(self.data, f"<u{tf}", count + 1, at + gap * (count + 1)).astype(np.int64)


class ShardSearch:
    """The lists of one shard that some query asks for."""

    def __init__(self, ids: list[int | None], lengths: np.ndarray, rows: Iterator[tuple[str, bytes, bytes, bytes]], documents: int, total: int):
        # by id, a null one last: so ties go to the earlier document
        self.ids = ids
        self.rank = np.empty(len(ids), dtype=np.int64)
        self.rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
        self.m = norms(lengths, documents, total)
        self.lists: dict[str, Postings] = {}
        self.open: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        self.decompressed = 0
        for term, blocks, pairs, data in rows:
            table, best = np.frombuffer(blocks, _BLOCKS), np.frombuffer(pairs, _PAIRS)
            impacts = impact(best["tf"].astype(np.int64), norms(best["n"], documents, total))
            heads = np.cumsum(table["pairs"].astype(np.int64)) - table["pairs"]
            self.lists[term] = Postings(table["last"].astype(np.int64), np.maximum.reduceat(impacts, heads), table, data)

    def block(self, term: str, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of one block; those decompressed for one query are kept until the next."""
        found = self.open.get((term, b))
        if found is None:
            docs, tf = self.lists[term].decompress(b)
            found = self.open[term, b] = docs, impact(tf, self.m[docs])
            self.decompressed += 1
        return found

    def search(self, query: list[tuple[str, int]], k: int) -> tuple[list[int], list[int]]:
        """Documents (places in the shard) and scores of the k best of one query, (term, weight with repeats) pairs."""
        asked = [(w * int(self.lists[t].largest.max()), t, w) for t, w in query if t in self.lists and w > 0]
        asked.sort(reverse=True)
        bounds = np.array([a[0] for a in asked], dtype=np.int64)
        # rest[i]: what lists i, i + 1, ... can add together
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        top_docs, top_scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        self.open, lo, width = {}, 0, FIRST_WINDOW
        for _, term, w in asked[:_HEADS]:
            # k documents of one block have at least these scores
            _, impacts = self.block(term, int(self.lists[term].largest.argmax()))
            if len(impacts) >= k:
                least = max(least, w * int(np.partition(impacts, len(impacts) - k)[len(impacts) - k]))
        while lo < len(self.ids):
            hi = min(len(self.ids), lo + width)
            # the last lists that cannot reach the threshold together are non-essential
            essential = int(np.searchsorted(-rest, -least, side="right"))
            partial, seen = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo, dtype=bool)
            for _, term, w in asked[:essential]:
                last = self.lists[term].last
                for b in range(int(np.searchsorted(last, lo)), min(len(last), int(np.searchsorted(last, hi - 1)) + 1)):
                    docs, impacts = self.block(term, b)
                    a, z = np.searchsorted(docs, (lo, hi))
                    partial[docs[a:z] - lo] += w * impacts[a:z]
                    seen[docs[a:z] - lo] = True
            docs = np.flatnonzero(seen)
            scores, docs = partial[docs], docs + lo
            if essential < len(asked) and len(docs):
                docs, scores = self._probe(asked[essential:], rest[essential:], docs, scores, least)
            good = scores >= least
            if good.any():
                top_docs, top_scores = np.concatenate([top_docs, docs[good]]), np.concatenate([top_scores, scores[good]])
                order = np.lexsort((self.rank[top_docs], -top_scores))[:k]
                top_docs, top_scores = top_docs[order], top_scores[order]
                if len(order) == k:
                    least = max(least, int(top_scores[-1]))
            lo, width = hi, min(2 * width, LAST_WINDOW)
        return top_docs.tolist(), top_scores.tolist()

    def _probe(self, lists: list[tuple], rest: np.ndarray, docs: np.ndarray, scores: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds the non-essential ``lists`` to the scores of those documents that can still reach ``least``."""
        near = scores + rest[0] >= least
        docs, scores = docs[near], scores[near]
        # the maxima of the blocks that hold the documents, summed from the last list on
        places, maxima = [], np.zeros((len(lists) + 1, len(docs)), dtype=np.int64)
        for i, (_, term, w) in enumerate(lists):
            p = self.lists[term]
            at = np.searchsorted(p.last, docs)
            places.append(at)
            maxima[i] = w * np.append(p.largest, 0)[at]
        maxima = np.cumsum(maxima[::-1], axis=0)[::-1]
        alive = np.arange(len(docs))
        for i, (_, term, w) in enumerate(lists):
            alive = alive[scores[alive] + maxima[i, alive] >= least]
            if not len(alive):
                break
            at, count = places[i][alive], len(self.lists[term].last)
            for b in np.unique(at[at < count]).tolist():
                mine = alive[at == b]
                held, impacts = self.block(term, b)
                where = np.minimum(np.searchsorted(held, docs[mine]), len(held) - 1)
                scores[mine] += np.where(held[where] == docs[mine], w * impacts[where], 0)
        alive = alive[scores[alive] >= least] if len(alive) else alive
        return docs[alive], scores[alive]


def _search(k: int, documents: int, total: int):
    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if postings.num_rows and queries.num_rows:
            cols = {c: postings.column(c) for c in ("term", "blocks", "pairs", "postings")}
            whole = next(i for i, t in enumerate(cols["term"]) if not t.is_valid)
            ids = postings.column("ids")[whole].as_py()
            lengths = postings.column("lengths")[whole].values.to_numpy()
            lists = ([c[i].as_py() for c in cols.values()] for i in range(postings.num_rows) if i != whole)
            shard = ShardSearch(ids, lengths, lists, documents, total)
            for query, item, asked in zip(*(queries.column(c).to_pylist() for c in ("query", "item_id", "asked"))):
                docs, scores = shard.search([(a["term"], a["w"]) for a in asked], k)
                for values, new in zip(out, ([query] * len(docs), [item] * len(docs), [ids[d] for d in docs], scores)):
                    values.extend(new)
        return pa.table([pa.array(v, pa.int64()) for v in out], names=["query", "item_id", "doc_id", "score"])

    return run


def search(index: DataFrame, asked: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score. ``index`` as ``build_index``, ``asked`` as ``query_terms`` return them."""
    shards = index.where("term is null")
    terms_of = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = shards.agg(F.sum(F.size("ids").cast("long")).alias("n"), F.sum(terms_of).alias("terms"), (F.max("part") + 1).alias("parts"), F.count("*").alias("shards")).first()
    documents, total = sums["n"] or 0, sums["terms"] or 1
    wanted = asked.select("term").distinct()
    postings = staged(index.where("term is not null").join(wanted, "term", "left_semi"), "postings")
    weights = postings.groupBy("term").agg(weight(F.sum("df"), documents).alias("w"))
    query = asked.join(weights, "term").groupBy("query", "item_id").agg(F.collect_list(F.struct("term", (F.col("w") * F.col("times")).alias("w"))).alias("asked"))
    query = staged(query, "weighted")
    # every query goes to every shard once; a shard's lists are never copied
    places = shards.select("part", "shard").hint("merge")
    sent = query.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((sums["parts"] or 1) - 1)))).join(places, "part")
    dealt = lambda rows: rows.repartition(max(1, min(sums["shards"], _TASKS)), "part", "shard").groupBy("part", "shard")
    found = dealt(postings.unionByName(shards)).cogroup(dealt(sent))
    found = found.applyInArrow(_search(k, documents, total), "query long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
