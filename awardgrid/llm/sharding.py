"""Sharding by sampled splitters (operator 5), DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from awardgrid.llm.common import Scratch

SEED = 17
#: Where null ids sort.
NO_ID = -(1 << 63)


KEY = "array<struct<k:bigint,id:bigint,n:bigint>>"


def _range_of(splitters: list[tuple], key: Column) -> Column:
    """Number of splitters at or below the key: a binary search over one literal array."""
    if not splitters:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps([dict(zip(("k", "id", "n"), s, strict=True)) for s in splitters])), KEY)
    steps, n = [], 1
    while n <= len(splitters):
        steps.insert(0, n)
        n *= 2
    step = lambda at, s: F.when((at + s <= len(splitters)) & (F.get(held, at + s - 1) <= key), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _draw(rows: DataFrame, n: int, total: int, seed: int) -> list[tuple]:
    """About n keys, each row drawn with a chance in proportion to its size of ``total``, independently.

    Rows choose themselves where they are, so nothing is sorted and no task holds more than its own.
    """
    u = (F.pmod(F.xxhash64("k", "id", "n", F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    drawn = rows.where(-F.log(u) / F.col("size") < n / total).select("k", F.coalesce("id", F.lit(NO_ID)).alias("id"), "n")
    return sorted(tuple(r) for r in drawn.collect())


def assign_shards(
    spark: SparkSession,
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    extra_bytes: int = 16,
    ranges_per_shard: int = 8,
    rows_per_range: int = 2_000_000,
    samples_per_range: int = 16,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; law ``bytes``.

    The key is (crc32 of the text, id, a number that no two rows share), so equal texts lie side by
    side, and a group of copies or of repeated rows of any size can still be cut. Size-weighted key samples give quantile boundaries; rows are
    partitioned into the ranges between them; ranges with over twice the mean bytes are subdivided
    at samples of their own rows. Within a range a running sum of sizes, on top of the bytes in all
    lower ranges, puts each row where it lies among all bytes: shard s takes the rows whose middle
    byte is in the s-th of ``shards`` equal parts. Shards therefore differ from the mean by one
    row's size at most, and depend on no sample, partitioning or run.

    Null text: no bytes, crc32 0. Null ids sort first. Equal rows get one place each, in any order.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    Very long texts are only measured. The driver holds splitters and samples only: ``shards * ranges_per_shard`` or rows / ``rows_per_range``.
    """
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + extra_bytes).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("k"),
            F.monotonically_increasing_id().alias("n"),  # written with the row, so it stays the same
        ),
        "rows",
    )
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = max(shards * ranges_per_shard, -(-count // rows_per_range))
    key = F.struct("k", F.coalesce("id", F.lit(NO_ID)).alias("id"), "n")
    drawn = _draw(rows, n * samples_per_range, total, SEED) if total else []
    splitters = sorted({drawn[i * len(drawn) // n] for i in range(1, n)} if drawn else set())
    for turn in range(1, 4):
        ranged = rows.withColumn("range", _range_of(splitters, key))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        over = {r["range"]: r["bytes"] for r in sums.where((F.col("bytes") > 2 * total / n) & (F.col("rows") > samples_per_range)).collect()}
        if not over:
            break
        parts = sum(-(-b * n // total) for b in over.values())
        more = _draw(ranged.where(F.col("range").isin(list(over))), parts * samples_per_range, sum(over.values()), SEED + turn)
        grown = sorted({*splitters, *more[::samples_per_range]})
        if grown == splitters:
            break
        splitters = grown
    ranged = rows.withColumn("range", _range_of(splitters, key))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, not the rows
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    run = Window.partitionBy("range").orderBy("k", "id", "n").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(run))
        .withColumn("nth", F.count("*").over(run))
        .join(F.broadcast(sums), "range")
        .select(
            "id", "size", "k",
            F.least(
                F.lit(shards - 1),
                F.expr(f"cast((2 * (bytes_before + upto) - size) * {shards} div {max(1, 2 * total)} as int)"),
            ).alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        )
    )
    placed = scratch.keep(placed, "placed")
    scratch.drop("rows")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("k").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
