"""Joins of labels and spellings: merge vetoes, connected groups."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes the shuffle files of an execution at its end, not when its plan is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own if the driver is the only
    machine (tests), else one below the warehouse, if that is no machine's own folder; it raises where every machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            found = "file://" + tempfile.mkdtemp(prefix="awardgrid-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if not re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", warehouse, re.I):
                raise ValueError(f"set spark.checkpoint.dir to a folder that all machines see; {warehouse} is each machine's own")
            found = warehouse.rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and reread: what several later steps read is made once, and
    outlives a lost executor. What was shuffled to make them is deleted at once, they when the driver ends."""
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/awardgrid/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(home)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(home)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more, not even a plan that is still to run."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def merge_veto(rows: DataFrame, reference: str, label: str, value: str, source: str, told: int = 60) -> DataFrame:
    """For each pair of labels: tenders where they have no value in common, those where they have one, and the veto.

    Tenders where two labels share a source line (its first ``told`` characters) don't count: they were
    read from one line. More tenders that differ than agree veto a merge. A tender's labels meet in a
    self equi-join on the tender; their values and lines travel as sets.
    """
    per = rows.groupBy(F.col(reference).alias("r"), F.col(label).alias("a")).agg(F.collect_set(value).alias("v"), F.collect_set(F.substring(source, 1, told)).alias("s"))
    other = per.select("r", F.col("a").alias("b"), F.col("v").alias("w"), F.col("s").alias("t"))
    pair = per.join(other, "r").where((F.col("a") < F.col("b")) & ~F.arrays_overlap("s", "t")).select("a", "b", F.arrays_overlap("v", "w").alias("same"))
    out = pair.groupBy("a", "b").agg(F.count_if(~F.col("same")).alias("diff"), F.count_if("same").alias("same"))
    return out.withColumn("veto", F.col("diff") > F.col("same"))


def near_values(rows: DataFrame, width: float) -> DataFrame:
    """Links (a, b) that connect what is connected by equal ``key`` and values ``x`` less than ``width`` apart.

    rows: id, key, x. Not all such pairs: values are cut into cells of half that width, whose members are
    all linked with their least one; of two cells that lie close the nearest members are. So there are at most
    a few links for each row, however many share a value.
    """
    near = rows.where("id is not null and key is not null and abs(x) < double('infinity')").withColumn("cell", F.floor(F.col("x") / (width / 2)))
    cells = written(near.groupBy("key", "cell").agg(F.min(F.struct("x", "id")).alias("low"), F.max(F.struct("x", "id")).alias("high"), F.count("*").alias("n"), F.min("id").alias("least")), "cells")
    inside = near.join(cells.where("n > 1").select("key", "cell", "least"), ["key", "cell"]).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    ahead = cells.select("key", "high", F.explode(F.array(*[F.col("cell") + i for i in (1, 2, 3)])).alias("cell"))
    across = ahead.join(cells.select("key", "cell", "low"), ["key", "cell"]).where(F.col("low.x") - F.col("high.x") < width).select(F.col("high.id").alias("a"), F.col("low.id").alias("b")).where("a <> b")
    return inside.union(across)


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of an undirected graph given by (a, b), root being the least id of the group.

    Each round is a large-star and a small-star step: first every node's larger neighbours go to the least
    one near it, then its smaller ones. Chains get shorter by a factor each time, so the rounds needed grow
    with the logarithm of the longest one, not its length; each is written to the checkpoint folder.
    """
    home = f"{shared_folder(spark)}/awardgrid/components-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{home}/{name}")
        return spark.read.schema(df.schema).parquet(f"{home}/{name}")

    told = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
    links = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null").distinct(), "links0")
    single, links = links.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root")), links.where("a <> b")
    before = told(links)
    for i in range(1, rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = keep(small.union(least.select("a", F.col("m").alias("b"))).distinct(), f"links{i}")
        now = told(links)
        if now == before:
            found = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found = found.union(links.select("b", "b").distinct())
            return found.union(single.join(found, "node", "left_anti"))
        before = now
    raise RuntimeError("components did not settle")
