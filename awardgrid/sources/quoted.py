"""Records of CSV files with quoted line breaks, read in parallel.

Spark's own reader takes such a file in one task, since a split can't know whether it starts inside
quotes. Here the lines of each split are read twice. First each split tells where it would end, inside
quotes or not, for either way it may start; put together from a file's first split on, that settles how each starts.
Then splits cut their lines into records. What begins in one split and ends in another is put together by the split it began in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from awardgrid.operators.matching import written


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line is inside quotes, if its start is or isn't.

    A field is quoted if it begins with a quote; two quotes in it are one; what stands behind the closing
    one, up to the comma, and quotes in other fields mean nothing.
    """
    if '"' not in line:
        return inside
    at = 0
    inside = inside or (line[0] == '"' and bool(at := 1))
    while True:
        if not inside:
            at = line.find(',"', at)
            if at < 0:
                return False
            at, inside = at + 2, True
        while (at := line.find('"', at)) >= 0 and line.startswith('""', at):
            at += 2
        if at < 0:
            return True
        comma = line.find(",", at)
        if comma < 0:
            return False
        at, inside = comma, False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line) in their order in each split."""
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, from_outside, from_inside, starts): how a split ends for either start, and whether a record
    starts in it if it starts inside."""
    told: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = told.setdefault((file, block), [False, True, False])
            own[2] |= not own[1]
            own[0], own[1] = (both := ends_inside(line, own[0])), both if own[0] == own[1] else ends_inside(line, own[1])
    yield pa.record_batch([pa.array([k[i] for k in told], t) for i, t in enumerate((pa.string(), pa.int64()))] + [pa.array([v[i] for v in told.values()], pa.bool_()) for i in range(3)], ["file", "block", "from_outside", "from_inside", "starts"])


def _split_starts(ends: DataFrame) -> DataFrame:
    """(file, block, owner) of splits that start inside quotes; owner is the split where their first record began.

    A split may leave the state as it is, turn it over, or settle it. So a split's start is what the last one before it that
    settles it says, turned over as often as splits since then do. Windows over a row for each split.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("from_outside") == F.col("from_inside")
    turns = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    rows = ends.withColumn("turns", turns)
    last = F.last(F.when(settles, F.struct("from_outside", "turns")), ignorenulls=True).over(before)
    rows = rows.withColumns({"last": last, "turned": F.coalesce(F.max("turns").over(before), F.lit(0))})
    inside = F.coalesce(F.col("last.from_outside"), F.lit(False)) != ((F.col("turned") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1)
    rows = rows.withColumn("inside", inside)
    owner = F.last(F.when(~F.col("inside") | F.col("starts"), F.col("block")), ignorenulls=True).over(before)
    return rows.withColumn("owner", owner).where("inside").select("file", "block", "owner")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, owner, nth, block, text, whole) of records and parts of them. A split's last record, and what it has of another split's, are parts."""
    schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("nth", pa.int64()), ("block", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])
    at, owner, nth, held, inside = None, None, 0, [], False
    for batch in batches:
        rows = []
        for file, block, line, began in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (file, block):
                if held:
                    rows.append((*at[:1], owner, nth, at[1], "\n".join(held), False))
                at, held, inside = (file, block), [], began is not None
                owner, nth = (began, -1) if inside else (block, 0)
            held.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                rows.append((file, owner, nth, block, "\n".join(held), nth >= 0))
                owner, nth, held = block, nth + 1, []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*at[:1], owner, nth, at[1], "\n".join(held), False), schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str, most_broadcast: int = 1_000_000) -> DataFrame:
    """(file, position, record) of every record of the files at ``path``; positions ascend in a file.

    Lines end with a line feed (a carriage return before one that ends a record goes). Files must not be compressed to be
    split. A record may span any number of splits; nothing is gathered but the parts of such records. An
    open quote at the end of a file ends there. Empty lines between records are no records.
    """
    lines = _lines(spark, path)
    ends = written(lines.mapInArrow(_split_ends, "file string, block long, from_outside boolean, from_inside boolean, starts boolean"), "splits")
    starts = written(_split_starts(ends), "inside")
    few = starts.count() <= most_broadcast
    told = lines.join(F.broadcast(starts), ["file", "block"], "left") if few else _told_in_order(lines, starts)
    cut = written(told.select("file", "block", "line", "owner").mapInArrow(_cut, "file string, owner long, nth long, block long, text string, whole boolean"), "records")
    whole = cut.where("whole").select("file", "owner", "nth", "text")
    # the last record that began in a split, and what later splits have of it (nth -1: not the first there)
    parts = cut.where("not whole").groupBy("file", "owner").agg(F.max("nth").alias("nth"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = parts.select("file", "owner", "nth", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    text = F.regexp_replace("text", r"\r\z", "")
    return whole.union(joined).select("file", (F.col("owner") + F.col("nth")).alias("position"), text.alias("record")).where("record <> ''")


def _told_in_order(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines with their split's owner where too many splits start inside quotes to send them to all tasks."""
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    return placed.join(starts, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "_at")
