"""Deterministic ordering and distributed global row numbering.

``row_number() over (order by ...)`` without a partition plans a single-partition
exchange: the whole table goes through one task. ``with_positions`` numbers rows
globally without that:

1. range-partition on the order key and sort inside partitions;
2. write that as Parquet to the shared folder, with the partition's number and the rank inside
   it as *columns*: they stay what they are however the table is read, split, coalesced or
   joined later, and readers still prune columns;
3. count rows per partition number (a partial aggregation);
4. pos = offset of the partition + rank inside it; the offsets are a table of one row per
   partition, joined on the partition number.

The order key must be unique (append a unique column); then ``pos`` does not
depend on the number of partitions.

``seeded_positions`` numbers seeded shuffles, whose order keys are md5 digests and so uniform: leading digits
give equal partitions whatever the data. No bounds are sampled; see there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavequery.session import written

_LOW33 = (1 << 33) - 1


def seeded_key(seed: int, *parts) -> Column:
    """md5 hex of ``seed|part1|part2...``; identical in Spark and DuckDB."""
    pieces: list[Column] = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit("|"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*pieces))


@dataclass
class Numbered:
    df: DataFrame  # input columns + pos (0-based, bigint)
    total: int  # number of rows


def _ranked(df: DataFrame, name: str, dealt: DataFrame, order: list[Column]) -> DataFrame:
    """``dealt`` sorted within its partitions and written, with ``_pid`` (the partition) and ``_rank`` (the place in it)."""
    dealt = dealt.sortWithinPartitions(*order)
    numbered = {"_pid": F.spark_partition_id(), "_rank": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))}
    return written(dealt.select(*df.columns, *[c.alias(n) for n, c in numbered.items()]), name)


def _ranged(df: DataFrame, order: list[Column | str], num_partitions: int | None) -> DataFrame:
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    # the range bounds are sampled in a first pass over the input, the shuffle is a second one
    return _ranked(df, "numbered", df.repartitionByRange(n, *order_cols), order_cols)


def _offsets(stable: DataFrame) -> tuple[DataFrame, int]:
    """(_pid, _off) and the total. The counts are a row per partition of the shuffle, as many as the driver keeps of its tasks anyway."""
    counts = sorted((r["_pid"], r["_n"]) for r in stable.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    total, offsets = 0, []
    for pid, rows in counts:
        offsets.append((pid, total))
        total += rows
    return F.broadcast(stable.sparkSession.createDataFrame(offsets, "_pid int, _off long")), total


def with_positions(df: DataFrame, order: list[Column | str], pos: str = "pos", num_partitions: int | None = None) -> Numbered:
    stable = _ranged(df, order, num_partitions)
    offsets, total = _offsets(stable)
    out = stable.join(offsets, "_pid").withColumn(pos, F.col("_off") + F.col("_rank"))
    return Numbered(out.select(*df.columns, pos), total)


#: Leading digits of a group's md5 whose cells are summed on the driver's side of a window: 4,096 prefixes.
GROUP_DIGITS = 3


def seeded_positions(df: DataFrame, seed: int, key: str, group: str | None = None, pos: str = "pos", num_partitions: int | None = None) -> Numbered:
    """Positions in the order of ``grouped_shuffle_order`` (or ``global_shuffle_order`` without a group), by radix.

    1. A row's partition is given by the leading digits of its own md5, which are uniform: all partitions are equal, and every group,
       also one that has a third of the rows, is spread over all of them. No bounds are sampled, so the input is read once; rows are shuffled once.
    2. Partitions are sorted by (group's md5, group, row's md5) and written with each row's rank.
    3. One count table, a row per (group, partition), gives the first position of each: partitions follow each other within a group as
       their digits do. Its running sums are taken within prefixes of the group's md5 and over these.

    A null group comes first, its rows by their own keys; a null key counts as empty.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    digest = F.coalesce(seeded_key(seed, group, own), seeded_key(seed, own)) if group else seeded_key(seed, own)
    named = df.withColumns({"_row": digest, "_group": F.col(group) if group else F.lit(0)})
    named = named.withColumn("_digest", seeded_key(seed, "_group") if group else F.lit(""))
    part = (F.conv(F.substring("_row", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int")
    order = [F.col(c) for c in ("_digest", "_group", "_row", key)]
    kept = df.withColumns({"_group": F.col(group) if group else F.lit(0)})
    stable = _ranked(kept, "seeded", named.repartitionById(n, part), order)
    cells = stable.groupBy("_group", "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_low"))
    cells = cells.withColumn("_digest", F.coalesce(seeded_key(seed, "_group"), F.lit("")) if group else F.lit(""))
    cells = cells.withColumn("_prefix", F.substring("_digest", 1, GROUP_DIGITS))
    rows_before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_inside", rows_before(Window.partitionBy("_prefix").orderBy("_digest", "_group", "_pid")))
    prefixes = cells.groupBy("_prefix").agg(F.sum("_n").alias("_n"))
    prefixes = prefixes.select("_prefix", rows_before(Window.orderBy("_prefix")).alias("_before"))  # 4,097 rows at most
    cells = cells.join(prefixes, "_prefix").select("_group", "_pid", (F.col("_before") + F.col("_inside") - F.col("_low")).alias("_off"))
    placed = same(stable, written(cells, "cells"), ["_group", "_pid"])
    return Numbered(placed.withColumn(pos, F.col("_off") + F.col("_rank")).select(*df.columns, pos), stable.count())


def grouped_shuffle_order(seed: int, group: str, key: str) -> list[Column]:
    """TOP-1: question groups in seeded order, rows seeded inside each group; groups stay contiguous."""
    return [seeded_key(seed, group), F.col(group), seeded_key(seed, group, key), F.col(key)]


def global_shuffle_order(seed: int, key: str) -> list[Column]:
    """TOP-2: seeded permutation of the whole list."""
    return [seeded_key(seed, key), F.col(key)]


def file_order(df: DataFrame, group: str, seq: str) -> tuple[DataFrame, list[Column]]:
    """TOP-3: no shuffle; groups in first-seen order, rows in file order.

    The first-seen position of each group is a grouped ``min`` joined back (an
    aggregate, partial per partition, instead of a window over a possibly huge group).
    """
    first = df.groupBy(group).agg(F.min(seq).alias("_first_seq"))
    return df.join(first, group), [F.col("_first_seq"), F.col(seq)]


def take_first(numbered: Numbered, num_data: int | None) -> Numbered:
    """TOP-4: keep the first ``num_data`` rows; 0/None keeps all."""
    if not num_data or num_data >= numbered.total:
        return numbered
    return Numbered(numbered.df.where(F.col("pos") < num_data), num_data)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys come back once, from the left."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def series_index(df: DataFrame, series: list[str], order: list[Column | str], out: str = "t",
                 length: str | None = None, num_partitions: int | None = None, position: str | None = None) -> DataFrame:
    """0-based position of each row inside its series, in ``order`` (plus the series length). ``position`` keeps the
    global one, by which operators on ordered series need not number the rows again.

    One form for every size: rows are range-partitioned by (series, order), which splits a huge series, and ranked
    (as in ``with_positions``). A count table, a row per series and partition, gives a series' rows in the partitions before and its
    length; it is joined back on (series, partition), unique on that side. Null is a series of its own.
    """
    keys = [F.col(c) for c in series] + [F.col(c) if isinstance(c, str) else c for c in order]
    stable = _ranged(df, keys, num_partitions)
    cells = stable.groupBy(*series, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_low"))
    whole = Window.partitionBy(*series)
    earlier = F.coalesce(F.sum("_n").over(whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = [F.sum("_n").over(whole).alias(length)] if length else []
    cells = written(cells.select(*series, "_pid", (earlier - F.col("_low")).alias("_shift"), *more), "cells")
    placed = same(stable, cells, [*series, "_pid"]).withColumn(out, F.col("_shift") + F.col("_rank"))
    if position:
        offsets, _ = _offsets(stable)
        placed = placed.join(offsets, "_pid").withColumn(position, F.col("_off") + F.col("_rank"))
    return placed.select(*df.columns, out, *([length] if length else []), *([position] if position else []))
