"""Shared pieces: the scratch folder all machines see, cut lineage, components, column hygiene."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.operators.matching import shared_folder


ROWS_PER_FILE = 250_000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of whole texts that are held at once: by the Parquet reader, and on the way to a Python worker.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Bound what executors hold of texts at once, unless the session says how much.

    With the defaults a reader holds 4,096 texts in one array and a Python worker gets 10,000, so the
    heap grows with the length of texts. Set on the session, since the plan that an operator returns
    runs later.
    """
    for key, most in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor.

    ``drop`` deletes those that nothing reads any more, ``drop_others`` all but some; what returned
    DataFrames read goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/awardgrid/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write and reread; the shuffle files of the write go when it is over, since no later job needs
        them. Where ``rows`` bounds the number of (short) rows, they go to a file for each
        ``ROWS_PER_FILE``."""
        if rows is not None:
            df = df.coalesce(max(4, -(-rows // ROWS_PER_FILE)))
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before) if before is not None else self.spark.conf.unset(CLEAN_UP)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no returned DataFrame reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)

    def drop_others(self, *kept: str) -> None:
        self.drop(*[name for name in self.paths if name not in kept])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one bounded partition as stars: every node with the least id it is connected to there."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(ids))
    yield pa.record_batch([pa.array(ids[far]), pa.array(ids[root[far]])], ["u", "v"])


def connected_components(scratch: Scratch, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of a written table ``edges`` (a long, b long); root is the smallest reachable id.

    First every ``ROWS_PER_FILE`` links are contracted to stars where they are read. Alternating
    large-star and small-star steps join the stars: every step is a minimum by key (combined before
    the shuffle) and an equi-join, and no neighbour list is ever gathered. Each round is written to
    the shared folder, and the one before is deleted. A node that very many links share is split by
    the adaptive skew join, since the other side has one row for it. Self-links and nulls are ignored. ``rounds`` only guards against a bug: the
    number needed grows with the logarithm of the longest chain, and running out raises.
    """
    n = edges.count()
    plain = edges.select("a", "b").where("a <> b").coalesce(max(1, -(-n // ROWS_PER_FILE)))
    held = f"cc-{uuid.uuid4().hex}"
    stars = scratch.keep(plain.mapInArrow(_contract, "u long, v long"), held)
    told = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
    before = told(stars)
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        old, held = held, f"cc-{uuid.uuid4().hex}"
        stars = scratch.keep(small, held, 2 * n)
        scratch.drop(old)
        now = told(stars)
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v"), F.col("v")).distinct()
    )


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
