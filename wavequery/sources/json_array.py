"""A splittable reader for JSON arrays of records: a Python data source over byte ranges.

``spark.read.json(multiLine=True)`` reads a file in one task, since a byte in the middle of an array says nothing about
whether it stands in a string or how deep it is nested. Both follow from what lies before it, and that composes:

1. every byte range is scanned on its own under both assumptions, that it starts inside a string and that it does
   not. Its summary is a few numbers: the strings it leaves open, the change of depth, and the records that begin at each relative
   depth (``what=summaries``);
2. the summaries, one row per range, are chained in file order on the driver, as the list of files is. Every range then
   knows its true state at the start and the number of records before it;
3. the ranges are read (``what=records``): a range owns the records that begin in it and reads past its end to finish the last.

Rows are (seq, value): the record's position over all files in name order, from 0, and its text. Parsing stays in the JVM
(``from_json``). Files in name order are one stream: each may hold a whole array, or the array may go on from file to file between records.

UTF-8 only, with or without a mark at the start. Objects that are elements of a top-level array are records; other elements are skipped. A top-level object, text
that ends inside an array or a string, and compressed files are refused. Paths may be local or of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Ranges a core beyond which they grow, up to SPLIT_BYTES: a task of a few hundred records costs more to start than to run.
RANGES_PER_CORE = 4
_PIECE = 4 << 20  # bytes held at once while scanning
_ROWS = 4096  # records of an Arrow batch, at most
_QUOTE, _BACKSLASH, _OPEN = 34, 92, 123
_DEPTH = np.zeros(256, dtype=np.int64)
_DEPTH[[123, 91]], _DEPTH[[125, 93]] = 1, -1


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; ``file:/x`` is as good as ``file:///x``."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of a folder's files in name order without hidden and marker files."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner))
    found = sorted((f for f in found if f.is_file and (info.is_file or f.base_name[0] not in "._")), key=lambda f: f.base_name)
    packed = [f.path for f in found if f.extension in ("gz", "bz2", "zst", "lz4", "snappy")]
    if packed:
        raise ValueError(f"compressed files cannot be split: {packed[0]}")
    prefix = path[: len(path) - len(inner)] if "://" in path else ""
    return [(prefix + f.path, f.size) for f in found if f.size]


@dataclass
class Range(InputPartition):
    """Bytes ``lo`` to ``hi`` of a file, with the state at ``lo`` once that is known."""

    path: str
    lo: int
    hi: int
    number: int
    in_string: bool = False
    depth: int = 0
    first: int = 0


def ranges(path: str, split_bytes: int) -> list[Range]:
    cuts = [(p, lo, min(size, lo + split_bytes)) for p, size in list_files(path) for lo in range(0, size, split_bytes)]
    return [Range(*c, number=i) for i, c in enumerate(cuts)]


def fitted(path: str, split_bytes: int, cores: int) -> int:
    """``split_bytes`` at least, and more, up to SPLIT_BYTES, where these would be over RANGES_PER_CORE ranges a core."""
    share = -(-sum(size for _, size in list_files(path)) // max(1, RANGES_PER_CORE * cores))
    return max(split_bytes, min(SPLIT_BYTES, share))


class _Marks:
    """Quotes and braces of consecutive pieces of one file; remembers a run of backslashes at a piece's end."""

    def __init__(self, escaped: bool):
        self.escaped = escaped  # the next byte stands after an odd run of backslashes

    def scan(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the quotes that open or close a string, and of all brackets."""
        b = np.frombuffer(piece, dtype=np.uint8)
        quotes = np.flatnonzero(b == _QUOTE)
        slashes = b == _BACKSLASH
        if self.escaped or slashes.any():
            at = np.arange(len(b))
            # the last byte before each place that is no backslash; a run that goes back to the start may go on before it
            other = np.maximum.accumulate(np.where(slashes, -1, at))
            before = np.concatenate([[-1], other[:-1]])
            run = at - 1 - before + ((before == -1) & self.escaped)
            odd = run % 2 == 1
            quotes = quotes[~odd[quotes]]
            self.escaped = bool(slashes[-1] and not odd[-1])
        return quotes, np.flatnonzero(_DEPTH[b])


def _pieces(file, lo: int, hi: int) -> Iterator[bytes]:
    while lo < hi:
        piece = file.read_at(min(_PIECE, hi - lo), lo)
        if not piece:
            return
        yield piece
        lo += len(piece)


def _escaped_at(file, at: int) -> bool:
    """Whether an odd run of backslashes ends just before ``at``."""
    run, lo = 0, at
    while lo > 0:
        hi, lo = lo, max(0, lo - 4096)
        back = file.read_at(hi - lo, lo)
        tail = len(back) - len(back.rstrip(b"\\"))
        run += tail
        if tail < len(back):
            break
    return run % 2 == 1


def summary(r: Range) -> dict:
    """``odd``: the range has an odd number of quotes. For each assumption: ``change`` of depth and records that would begin at each relative depth."""
    system, inner = _open(r.path)
    quotes_so_far, depth, starts = 0, [0, 0], [{}, {}]
    with system.open_input_file(inner) as file:
        marks = _Marks(_escaped_at(file, r.lo))
        for piece in _pieces(file, r.lo, r.hi):
            b = np.frombuffer(piece, dtype=np.uint8)
            quotes, brackets = marks.scan(piece)
            inside = (quotes_so_far + np.searchsorted(quotes, brackets)) % 2 == 1
            for assumed in (0, 1):
                real = brackets[inside == bool(assumed)]
                change = _DEPTH[b[real]]
                after = depth[assumed] + np.cumsum(change)
                levels, counts = np.unique((after - change)[b[real] == _OPEN], return_counts=True)
                for level, n in zip(levels.tolist(), counts.tolist()):
                    starts[assumed][level] = starts[assumed].get(level, 0) + n
                if len(after):
                    depth[assumed] = int(after[-1])
            quotes_so_far += len(quotes)
    return {"number": r.number, "odd": quotes_so_far % 2 == 1, "change": depth, "starts": starts}


def chain(found: list[Range], summaries: list[dict]) -> list[Range]:
    """The ranges with their true states: each starts as the one before it ends."""
    in_string, depth, first, out = False, 0, 0, []
    by_number = {s["number"]: s for s in summaries}
    for r in found:
        s = by_number[r.number]
        out.append(Range(r.path, r.lo, r.hi, r.number, in_string, depth, first))
        starts = {int(level) + depth: n for level, n in s["starts"][in_string].items()}
        if starts.get(0):
            raise ValueError(f"{r.path}: an object outside an array")
        first += starts.get(1, 0)
        depth += s["change"][in_string]
        in_string ^= s["odd"]
        if depth < 0:
            raise ValueError(f"{r.path}: a bracket closes that was not opened")
    if depth or in_string:
        raise ValueError("the text ends inside an array or a string")
    return out


def records(r: Range) -> Iterator[tuple[int, bytes]]:
    """(position, text) of the records that begin in the range."""
    system, inner = _open(r.path)
    with system.open_input_file(inner) as file:
        marks, in_string, depth, seq = _Marks(_escaped_at(file, r.lo)), r.in_string, r.depth, r.first
        held, at = None, r.lo  # parts of a record that goes on, and the place of the piece
        for piece in _pieces(file, r.lo, file.size()):
            if at >= r.hi and held is None:
                return
            b = np.frombuffer(piece, dtype=np.uint8)
            quotes, brackets = marks.scan(piece)
            inside = (np.searchsorted(quotes, brackets) + in_string) % 2 == 1
            real = brackets[~inside]
            change = _DEPTH[b[real]]
            after = depth + np.cumsum(change)
            starts = real[(b[real] == _OPEN) & (after == 2)].tolist()
            ends = real[(b[real] == 125) & (after == 1)].tolist()
            if held is not None and ends:
                held.append(piece[: ends[0] + 1])
                yield seq, b"".join(held)
                seq, held, ends = seq + 1, None, ends[1:]
            elif held is not None:
                held.append(piece)
            elif depth > 1 and ends:
                ends = ends[1:]  # of a record that began before the range
            if held is None:
                for k, start in enumerate(starts):
                    if at + start >= r.hi:
                        return
                    if k < len(ends):
                        yield seq, piece[start : ends[k] + 1]
                        seq += 1
                    else:
                        held = [piece[start:]]
            in_string = bool((len(quotes) + in_string) % 2)
            depth = int(after[-1]) if len(after) else depth
            at += len(piece)
        if held is not None:
            raise ValueError(f"{r.path}: a record goes on in another file")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, summaries: bool):
        self.summaries, self.path, self.split_bytes = summaries, options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.states = options.get("states")

    def partitions(self) -> list[Range]:
        found = ranges(self.path, self.split_bytes)
        if not self.summaries:
            states = json.loads(self.states)
            if len(states) != len(found):
                raise ValueError(f"{self.path} has changed since its ranges were scanned")
            found = [Range(r.path, r.lo, r.hi, r.number, bool(s), d, n) for r, (s, d, n) in zip(found, states)]
        return found or [Range("", 0, 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        if self.summaries:
            yield pa.RecordBatch.from_pydict({"number": pa.array([partition.number], pa.int32()), "summary": [json.dumps(summary(partition))]})
            return
        seqs, texts, size = [], [], 0
        for seq, text in records(partition):
            seqs.append(seq)
            texts.append(text.decode())
            size += len(text)
            if len(seqs) >= _ROWS or size >= _PIECE:
                yield pa.RecordBatch.from_pydict({"seq": pa.array(seqs, pa.int64()), "value": pa.array(texts, pa.string())})
                seqs, texts, size = [], [], 0
        if seqs:
            yield pa.RecordBatch.from_pydict({"seq": pa.array(seqs, pa.int64()), "value": pa.array(texts, pa.string())})


class JsonArraySource(DataSource):
    """``spark.read.format("json_array")``: see the module. Options: path, splitBytes, what, states (of ``read_json_arrays``)."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "number int, summary string" if self._summaries() else "seq long, value string"

    def _summaries(self) -> bool:
        return self.options.get("what") == "summaries"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), self._summaries())


def read_json_arrays(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(seq, value) of all records under ``path``; one scan for the summaries, then a lazy one for the records.
    ``split_bytes`` is the least that a task reads (``fitted``)."""
    spark.dataSource.register(JsonArraySource)
    split_bytes = fitted(path, split_bytes, spark.sparkContext.defaultParallelism)
    source = lambda what: spark.read.format("json_array").option("splitBytes", split_bytes).option("what", what)
    found = [json.loads(r["summary"]) for r in source("summaries").load(path).collect()]  # one row per byte range
    states = [(int(r.in_string), r.depth, r.first) for r in chain(ranges(path, split_bytes), found)]
    return source("records").option("states", json.dumps(states)).load(path)
