"""Last-state, top-k, sampling, capped and carried-forward selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fresh(df: DataFrame, base: str) -> str:
    while base in df.columns:
        base = "_" + base
    return base


def spread(df: DataFrame, rows: int, *keys: str | Column, each: int = 200_000) -> DataFrame:
    """The rows dealt by ``keys`` to a task for ``each`` of some ``rows``: what a task sorts or groups doesn't grow with the input.

    Adaptive execution sizes tasks by compressed bytes, of which narrow rows have few.
    """
    least = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 10_000))
    return df.repartition(max(1, least, -(-rows // each)), *keys)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in ``order``; ties must be broken by the order given."""
    name = _fresh(df, "nth")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the place of each row in ``order``, from 1, whatever the keys look like.

    Rows are sorted into ranges and written; each range's rows are numbered where they lie, on top of
    the sizes of the ranges before it. No task sees more than a range.
    """
    import uuid

    from awardgrid.operators.matching import shared_folder

    spark = df.sparkSession
    home = f"{shared_folder(spark)}/awardgrid/numbered-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    at = _fresh(df, "_at")
    df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()).write.parquet(home)
    rows = spark.read.schema(df.schema.add(at, "long")).parquet(home).withColumn("_range", F.shiftright(at, 33))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))  # a row for each range
    return rows.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(at, "_range", "_before")


def running(df: DataFrame, keys: list[str], order: list[Column], stretch: Column, aggregates: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds, for each row, aggregates over the rows of its key that come before it in ``order``.

    ``stretch`` cuts a key's order into stretches (a day, say) and never falls along it. A window only
    sorts a key's stretch; what lies in earlier stretches is one row for each. aggregates: name ->
    (count, sum, min or max, column).
    """
    kinds = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    joins = {"count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "sum": lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0))), "min": F.least, "max": F.greatest}
    rows = df.withColumn("_stretch", stretch).withColumns({f"_v_{n}": c for n, (_, c) in aggregates.items()})
    whole = rows.groupBy(*keys, "_stretch").agg(*[kinds[k](f"_v_{n}").alias(f"_w_{n}") for n, (k, _) in aggregates.items()])
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    over = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    carried = whole.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_stretch").alias("_s"), *[over[k](f"_w_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in aggregates.items()])
    here = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_h_{n}": kinds[k](f"_v_{n}").over(here) for n, (k, _) in aggregates.items()})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_stretch").eqNullSafe(F.col("_s"))]
    out = rows.join(carried, on, "left").withColumns({n: joins[k](F.col(f"_c_{n}"), F.col(f"_h_{n}")) for n, (k, _) in aggregates.items()})
    return out.select(*df.columns, *aggregates)


def within(df: DataFrame, keys: list[str], at: str, value: str, reach: int, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of a key whose whole number ``at`` is at most ``reach`` below the row's, or equal to it.

    Stretches of ``reach`` are sorted, each with the one before. A row's sum is what its stretches hold up to it
    less what lies too far back, and both are running sums, so a row costs the same however many are near it.
    """
    stretch = F.floor(F.col(at) / reach)
    rows = df.withColumn("_own", stretch).withColumn("_stretch", F.explode(F.array_distinct(F.array(stretch, stretch + 1))))
    w = Window.partitionBy(*keys, "_stretch").orderBy(at)
    upto, far = F.sum(value).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.sum(value).over(w.rangeBetween(Window.unboundedPreceding, -reach - 1))
    rows = rows.withColumns({"_upto": upto, "_far": far}).where("_own <=> _stretch")
    return rows.withColumn(name, F.col("_upto") - F.coalesce(F.when(F.col(at).isNotNull(), F.col("_far")), F.lit(0))).drop("_own", "_stretch", "_upto", "_far")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows of each group, evenly spaced in its order: those at int(i * n / k)."""
    w = Window.partitionBy(*keys)
    at, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    rows = df.withColumn("_at", at).withColumn("_n", n)
    # int(i * n / k) = at for some i exactly if the count of multiples changes between at and at + 1
    cut = F.ceil((F.col("_at") + 1) * k / F.col("_n")) > F.ceil(F.col("_at") * k / F.col("_n"))
    return rows.where((F.col("_n") <= k) | cut).drop("_at", "_n")


def capped_points(df: DataFrame, keys: list[str], kind: str, order: list[Column], points: Column, caps: dict[str, int]) -> DataFrame:
    """Adds ``counted``: a row's points, 0 once its kind has had as many rows as its cap allows."""
    nth = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    cap = F.lit(None).cast("int")
    for name, most in caps.items():
        cap = F.when(F.col(kind) == name, most).otherwise(cap)
    return df.withColumn("counted", F.when(cap.isNotNull() & (nth > cap), 0).otherwise(points))


def carried_forward(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last non-null value at or above each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def collapse_pairs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups of exactly two rows with two different values become one row with both ends, width and middle."""
    pair = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(value).alias("d"), F.min(value).alias("low"), F.max(value).alias("high"))
    return pair.where("n = 2 and d = 2").select(*keys, "low", "high", (F.col("high") - F.col("low")).alias("width"), ((F.col("high") + F.col("low")) / 2).alias("middle"))


def keep_first_counted(df: DataFrame, keys: list[str], order: list[str], count: str = "restated") -> DataFrame:
    """The row of each key that is least by the columns ``order``, with the number of rows that share the key.

    Both are combined before the shuffle.
    """
    other = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*other).alias("_row")))
    out = df.groupBy(*keys).agg(first.alias("_first"), F.count("*").alias("_count"))
    return out.select(*keys, *[F.col(f"_first._row.{c}").alias(c) for c in other if c != count], F.col("_count").alias(count))
