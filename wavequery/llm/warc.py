"""A deterministic, sharded WARC writer and its reader.

Records are sorted by page id and dealt into shards: contiguous ranges of about ``shard_bytes`` of
payload (more where that would make over ``SHARDS`` of them), found from running sums of bytes in that order. One
task writes a shard; it rolls to the next file when ``roll_bytes`` of compressed records are out. Headers, digests, record ids and the gzip members are made anew
from the row alone, so a repeated task writes the same bytes. A file is written under a
temporary name and moved to its own; it counts only when the manifest, written last by Spark's committer, lists it
with its size and SHA-256, which the reader checks.

Of records with equal payloads of at least ``minimum`` bytes, that with the largest page id is the
response, the others are revisits of it; rows that repeat the largest id too are responses.

Null html is an empty payload, a null url has no target header; a null page id is never the largest. Repeated rows give
a record each (which of several shards holds how many follows the order they are read in, if they fill more than one); an empty table gives no file and no row. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavequery.operators.ordering import with_positions

from .common import only, staged, staging_path

SHARDS, SHARD_BYTES, ROLL_BYTES, MINIMUM, CHUNK, DATE = 1 << 16, 32 << 20, 16 << 20, 1000, 1 << 16, "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
_SCHEMA = "file string, shard int, part int, records long, payload_bytes long, file_bytes long, sha256 string"


def digested(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest."""
    rows = only(pages, page_id="page_id", url="url", html="html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})


def typed(rows: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Adds refers_to: the response's page id for revisits, else null."""
    same = ["payload_digest", "payload_bytes"]
    large = rows.where(F.col("payload_bytes") >= minimum)
    copies = large.groupBy(*same).agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null")
    rows = rows.join(staged(copies.drop("n"), "copies"), same, "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.withColumn("refers_to", F.when(again, F.col("kept"))).drop("kept")


def sharded(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """Adds shard and key; also returns the number of shards (``SHARDS`` and a few at most).

    Distinct keys are numbered in order (range partitions), and running sums of their bytes, by chunks of positions,
    cut them into shards; only each shard's first key comes to the driver. A key whose rows exceed a
    shard (repeated rows) is dealt out over as many as it fills."""
    spark = rows.sparkSession
    # sorts like the page id (null first); rows of one id are dealt by a hash
    signed = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    own = F.lpad(F.hex(F.xxhash64("payload_digest", "url")), 16, "0")
    rows = rows.withColumn("key", F.concat(F.coalesce(F.concat(F.lit("1"), signed), F.lit("0" * 17)), own))
    sizes = rows.groupBy("key").agg(F.sum(F.col("payload_bytes") + 512).alias("size"), F.count("*").alias("n"))
    sizes = staged(sizes, "key-sizes")
    shard_bytes = max(shard_bytes, (sizes.agg(F.sum("size")).first()[0] or 0) // SHARDS)
    fill = F.least(F.ceil(F.col("size") / shard_bytes), "n")
    large = staged(sizes.select("key", fill.alias("parts")).where("parts > 1"), "large-keys")  # at most 2 * SHARDS rows
    last = lambda part: F.concat("key", F.lpad(F.hex(part), 8, "0"))
    if large.isEmpty():
        sizes, rows = (x.withColumn("key", last(F.lit(0).cast("long"))) for x in (sizes, rows))
    else:
        each = F.coalesce("parts", F.lit(1).cast("long"))
        sizes = sizes.join(F.broadcast(large), "key", "left").select("key", (F.col("size") / each).cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), each - 1)).alias("part"))
        sizes = sizes.select(last(F.col("part")).alias("key"), "size")
        # rows of a large key are alike, so only a number deals them out; it is written with them, for a task that runs again may number
        # its rows otherwise
        dealt = rows.join(F.broadcast(large), "key").withColumn("at", F.monotonically_increasing_id())
        dealt = staged(dealt.withColumn("key", last(F.pmod("at", "parts"))).drop("at", "parts"), "dealt-rows")
        others = rows.join(F.broadcast(large.select("key")), "key", "left_anti").withColumn("key", last(F.lit(0).cast("long")))
        rows = others.unionByName(dealt)
    placed = with_positions(sizes.select("key", "size"), ["key"]).df.withColumn("chunk", F.expr(f"pos div {CHUNK}"))
    chunks = placed.groupBy("chunk").agg(F.sum("size").alias("sum"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per CHUNK keys
    chunks = staged(chunks.select("chunk", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before")), "chunks")
    inside = Window.partitionBy("chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    shard = placed.join(chunks, "chunk").select("key", F.floor(before / shard_bytes).alias("shard"))
    starts = shard.groupBy("shard").agg(F.min("key").alias("key")).toArrow().column("key").to_pylist()
    shared = spark.sparkContext.broadcast(np.sort(np.array(starts, dtype="S41")))

    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(dtype="S41"), side="right").astype(np.int32) - 1)

    return rows.withColumn("shard", find("key")), max(1, len(starts))


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member: headers, block and the two line ends after it."""
    lines = [("Content-Length", str(len(block))), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, *lines])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url, payload: bytes, refers_to, digest: str) -> bytes:
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Date", DATE),
        ("WARC-Record-ID", _id(page_id, digest)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if refers_to is not None:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(headers, http + (payload if refers_to is None else b""))


def info_record(name: str) -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Record-ID", _id(None, name)), ("WARC-Filename", name)]
    return _record([*headers, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


class _File:
    """One archive under a temporary name; ``commit`` moves it to its own and returns its manifest row."""

    def __init__(self, fs, root: str, shard: int, part: int):
        self.fs, self.shard, self.part = fs, shard, part
        self.name = f"{shard:06d}-{part:05d}.warc.gz"
        self.temporary, self.final = f"{root}/_temporary/{self.name}.{uuid.uuid4().hex}", f"{root}/{self.name}"
        fs.create_dir(f"{root}/_temporary", recursive=True)
        self.out, self.sha = fs.open_output_stream(self.temporary, compression=None), hashlib.sha256()
        self.size = self.records = self.payload = 0
        self.put(info_record(self.name), 0)
        self.records = 0

    def put(self, data: bytes, payload: int) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.payload += payload
        self.records += 1

    def commit(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return {"file": self.name, "shard": self.shard, "part": self.part, "records": self.records, "payload_bytes": self.payload, "file_bytes": self.size, "sha256": self.sha.hexdigest()}


def _writer(uri: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(uri)
        names = ["file", "shard", "part", "records", "payload_bytes", "file_bytes", "sha256"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        pack = lambda row: pa.record_batch([pa.array([row[k]], t) for k, t in zip(names, kinds)], names=names)
        now: _File | None = None
        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "page_id", "url", "payload", "refers_to", "payload_digest")]
            for i in range(batch.num_rows):
                shard, page_id, url, payload, refers_to, digest = (c[i].as_py() for c in cols)
                if now and (now.shard != shard or now.size >= roll_bytes):
                    part = now.part + 1 if now.shard == shard else 0
                    yield pack(now.commit())
                    now = _File(fs, root, shard, part)
                elif now is None:
                    now = _File(fs, root, shard, 0)
                now.put(page_record(page_id, url, payload, refers_to, digest), len(payload))
        if now:
            yield pack(now.commit())

    return run


def write(pages: DataFrame, uri: str, minimum: int = MINIMUM, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives under ``uri`` (a folder all executors reach) and returns the committed manifest."""
    from pyarrow.fs import FileSystem, FileType

    rows, shards = sharded(typed(digested(pages), minimum), shard_bytes)
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "payload_digest", "url")
    rows = rows.select("shard", "page_id", "url", "payload", "refers_to", "payload_digest")
    rows.mapInArrow(_writer(uri, roll_bytes), _SCHEMA).write.parquet(f"{uri}/manifest")
    fs, root = FileSystem.from_uri(uri)
    if fs.get_file_info(f"{root}/_temporary").type == FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")  # what failed or doubled attempts left
    return pages.sparkSession.read.schema(_SCHEMA).parquet(f"{uri}/manifest")


def records(stream, on_bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of a file."""
    data, opened, body = b"", None, []
    while True:
        if not data:
            data = stream.read(1 << 20)
            on_bytes(data)
            if not data:
                break
        if opened is None:
            opened, body = zlib.decompressobj(31), []
        body.append(opened.decompress(data))
        data = opened.unused_data
        if opened.eof:
            head, _, block = b"".join(body).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            if lines[0] != "WARC/1.1" or len(block) != int(headers["Content-Length"]) + 4:
                raise ValueError("a record is cut")
            yield headers, block[:-4]
            opened = None
        else:
            data = b""
    if opened is not None:
        raise ValueError("a file ends inside a record")


def _reader(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(uri)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}

        def page(headers: dict[str, str], block: bytes) -> dict:
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rsplit(b"Content-Length: ", 1)[1])
            kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if headers["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}" or kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                raise ValueError("a digest does not fit its record")
            number = lambda name: int(headers[name]) if name in headers else None
            return {"page_id": number("X-Page-ID"), "url": headers.get("WARC-Target-URI"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID")}

        for batch in batches:
            for f in batch.to_pylist():
                sha, seen, held, weight = hashlib.sha256(), 0, [], 0
                with fs.open_input_stream(f"{root}/{f['file']}", compression=None) as stream:
                    for headers, block in records(stream, sha.update):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        held.append(page(headers, block))
                        seen, weight = seen + 1, weight + len(block)
                        if weight >= 4 << 20 or len(held) >= 1000:
                            yield pa.RecordBatch.from_pylist(held, schema=pa.schema(kinds))
                            held, weight = [], 0
                if (sha.hexdigest(), seen) != (f["sha256"], f["records"]):
                    raise ValueError(f"{f['file']} is not what the manifest lists")
                yield pa.RecordBatch.from_pylist(held, schema=pa.schema(kinds))

    return run


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """The records of committed archives: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to."""
    files = manifest.agg(F.count("*")).first()[0]
    spread = manifest.repartition(max(1, files))
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return spread.mapInArrow(_reader(uri), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, read back, and return what the archives say of each page."""
    uri = staging_path(pages.sparkSession, "warc")
    back = read(write(pages, uri), uri)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
