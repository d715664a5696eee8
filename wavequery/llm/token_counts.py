"""Token counts by heap-and-linked-list byte-pair merging over a byte-level vocabulary file.

A text is cut at the vocabulary's special strings, one token each, as the library does by default. The rest
is split by the file's pattern into pieces. A piece starts as a linked list of its bytes. A heap holds its adjacent pairs that the
vocabulary merges, by rank and place; the lowest is popped and merged until none is left. The piece counts
its initial symbols less its merges: no token is ever formed or looked up. Counts of short pieces are remembered per
worker in a bounded cache.

Texts are split by the pattern in Python where they hold characters below U+0250 only, for which both regular expression engines
agree on letters, digits and blanks; other parts are split by the library. Long texts are cut before single blanks
between non-blank characters, where a piece always starts.

Null text counts as empty (no token); texts and pieces of any length are counted whole, with memory in proportion to the longest.
Repeated rows, rows of one id and null ids are counted row by row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import safe_parts
from .common import Memo, only, portions

LIMIT = 512
_CACHE = 1_000_000  # pieces remembered per worker
_PLACE = (1 << 40) - 1
_KNOWN = re.compile("[\0-ɏ]*")
# fixed value: the split pattern of byte-level vocabulary files
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary file writes each byte: printable ones stand for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """Ranks of symbol pairs; symbols 0 to 255 are the bytes, symbol 256 + r is what the merge of rank r makes."""

    def __init__(self, pairs: list[tuple[str, str]]):
        symbol = {letter: b for b, letter in enumerate(byte_letters())}
        none: dict[int, int] = {}
        self.rank = [none] * (256 + len(pairs))  # of a left symbol: right symbol -> rank
        for r, (left, right) in enumerate(pairs):
            a, b = symbol[left], symbol[right]
            if self.rank[a] is none:
                self.rank[a] = {}
            self.rank[a][b] = r
            if symbol.setdefault(left + right, 256 + r) != 256 + r:
                raise ValueError("two merges make one symbol")

    def count(self, piece: bytes) -> int:
        """Tokens of one piece: its bytes less its merges."""
        n, rank = len(piece), self.rank
        # an entry of the heap: the pair's rank, then its place
        heap = [r << 40 | i for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := rank[a].get(b)) is not None]
        if not heap:
            return n
        heapify(heap)
        if n < 4096:
            symbols, after, before = list(piece), list(range(1, n + 1)), list(range(-1, n - 1))
        else:
            symbols, after, before = array("i", iter(piece)), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        merges = 0
        while heap:
            entry = heappop(heap)
            r, i = entry >> 40, entry & _PLACE
            j = after[i]
            # an entry is stale when either of its symbols has been merged since
            if j >= n or symbols[i] < 0 or rank[symbols[i]].get(symbols[j]) != r:
                continue
            merges += 1
            made = symbols[i] = 256 + r
            symbols[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (s := rank[made].get(symbols[j])) is not None:
                    heappush(heap, s << 40 | i)
            h = before[i]
            if h >= 0 and (s := rank[symbols[h]].get(made)) is not None:
                heappush(heap, s << 40 | h)
        return n - merges


@lru_cache(maxsize=2)
def _counter(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    bytewise = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if spec["normalizer"] or odd or not (plain and bytewise):
        raise ValueError(f"{path}: not a plain byte-level vocabulary")
    merges = Merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
    letters, library = {c: b for b, c in enumerate(byte_letters())}, Tokenizer.from_file(path).pre_tokenizer
    special = [t["content"] for t in spec["added_tokens"]]
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    pieces = Memo(lambda piece: merges.count(piece.encode()), _CACHE // 2)

    def part(text: str) -> int:
        if (text[1:] if text[0] == " " else text).isalpha() and (text.isascii() or _KNOWN.fullmatch(text)):
            return pieces[text]  # letters after a blank are one piece
        if _KNOWN.fullmatch(text):
            return sum(map(pieces.__getitem__, _PIECES.findall(text)))
        split = library.pre_tokenize_str(text)
        return sum(merges.count(bytes(map(letters.__getitem__, piece))) for piece, _ in split)

    parts = Memo(part, _CACHE)

    def segment(text: str) -> int:
        return sum(map(parts.__getitem__, safe_parts(text)))

    def count(text: str) -> int:
        found = cut.split(text) if cut else [text]
        return sum(segment(s) for s in found if s) + len(found) - 1

    def counts(texts: list[str]) -> list[int]:
        return [count(t) if n is None else n for t, n in zip(texts, _by_words(texts, parts, special))]

    return counts


def _by_words(texts: list[str], parts: dict[str, int], special: list[str]) -> list[int | None]:
    """Counts of texts, every distinct word counted once; None where a blank is no safe boundary or a special string is there."""
    words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    ends = words.offsets.to_numpy()
    coded = pc.dictionary_encode(words.flatten())
    at, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    # a word that is empty or has white space at an end stands beside a blank that is no safe boundary
    odd = np.fromiter((not w or w[0].isspace() or w[-1].isspace() or any(t in w for t in special) for w in distinct), bool, len(distinct))
    heads = np.zeros(len(at), dtype=bool)
    heads[ends[:-1]] = True
    bad = np.concatenate([[0], np.cumsum(odd[at])])
    simple = bad[ends[1:]] == bad[ends[:-1]]
    in_simple = np.repeat(simple, np.diff(ends))
    counts = np.zeros(len(at), dtype=np.int64)
    for before, where in (("", heads & in_simple), (" ", ~heads & in_simple)):
        used = np.zeros(len(distinct), dtype=bool)
        used[at[where]] = True
        of_word = np.zeros(len(distinct), dtype=np.int64)
        of_word[used] = [parts[before + distinct[i]] for i in np.flatnonzero(used).tolist()]
        counts[where] = of_word[at[where]]
    total = np.concatenate([[0], np.cumsum(counts)])
    return [n if s else None for n, s in zip((total[ends[1:]] - total[ends[:-1]]).tolist(), simple.tolist())]


def count_text(text: str, path: str) -> int:
    """Tokens of one text under the vocabulary file at ``path``."""
    return _counter(path)([text])[0]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens): one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            for part, texts in portions(batch, 2):
                yield pa.record_batch([part.column(0), part.column(1), pa.array(count(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = only(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
