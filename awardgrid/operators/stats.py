"""Robust statistics of groups, peers and distributions.

All functions are aggregates and equi-joins: partial sums before the shuffle where the function has
them, and exact medians (which hold one group's distinct values) only over keys with many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: makes a median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826
#: Groups of up to so many values are sorted by a task; larger ones are counted by ranges of values.
TASK_VALUES = 1_000_000


def group_median_mad(df: DataFrame, keys: list[str], value: str, least: int = 20, digits: tuple[int, int] | None = None, large: bool = False, task_values: int = TASK_VALUES) -> DataFrame:
    """Per group: n, median and scaled median absolute deviation, for groups of ``least`` values or more.

    Null values are left out; a null key is a group. The deviation is taken from the median as it is;
    ``digits`` rounds both afterwards. ``large``: few groups, each of which may be too large for a task;
    they are counted first, and with over ``task_values`` values in any of them, medians come from
    ranges of values (see ``values_at``).
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    large = large and _largest(rows, keys) > task_values
    centre = large_group_median(rows, keys, "_x") if large else rows.groupBy(*keys).agg(F.count("*").alias("n"), F.median("_x").alias("median"))
    centre = centre.where(F.col("n") >= least)
    on = [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)]
    far = rows.join(centre.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], "n", "median"), on)
    far = far.select(*keys, "n", "median", F.abs(F.col("_x") - F.col("median")).alias("_far"))
    if large:
        out = _deviation(far, keys)
    else:
        out = far.groupBy(*keys, "n", "median").agg(F.median("_far").alias("mad"))
    out = out.withColumn("mad", F.col("mad") * MAD_SCALE)
    return out.withColumns({"median": F.bround("median", digits[0]), "mad": F.bround("mad", digits[1])}) if digits else out


def _largest(rows: DataFrame, keys: list[str]) -> int:
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _deviation(far: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median, mad) from rows with their distance from the group's median."""
    own = far.select(*keys, F.col("median").alias("_median"), "_far")
    found = large_group_median(own, [*keys, "_median"], "_far")
    return found.select(*keys, "n", F.col("_median").alias("median"), F.col("median").alias("mad"))


def z_score(value: Column, median: Column, mad: Column) -> Column:
    """Null where the deviation is zero or missing."""
    return F.when(mad > 0, (value - median) / mad)


def nested_peer_stats(df: DataFrame, keys: list[str], member: str, value: str, least: int = 8, low: str | None = None, high: str | None = None) -> DataFrame:
    """Per key: statistics over its members' medians, so that a member with many values counts once.

    With the ends ``low`` and ``high`` of bands also ``median_band``, over the members' median widths,
    and ``n_bands``, the members that state a band.
    """
    width = F.median(F.col(high) - F.col(low)) if low and high else F.lit(None).cast("double")
    inner = df.where(F.col(value).isNotNull()).groupBy(*keys, member).agg(F.median(value).alias("v"), width.alias("w"))
    stats = group_median_mad(inner, keys, "v", least)
    ends = inner.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.median("w").alias("median_band"), F.count("w").alias("n_bands"))
    out = stats.join(ends, keys).withColumn("spread", F.col("high") - F.col("low"))
    return out if low and high else out.drop("median_band", "n_bands")


def leave_one_out(df: DataFrame, keys: list[str], member: str, value: str, least: int = 8) -> DataFrame:
    """Each member's value with the median and scaled deviation of its peers: the key's other members.

    Without the member at place i, the median is one of at most three values around the middle. So a
    key's members are ranked once by value, and once by their distance from each of those medians; the
    deviation again lies around the middle of that. Two sorts of each key, no arrays, and rows are
    only tripled. Only keys with over ``least`` members.
    """
    one = df.where(F.col(value).isNotNull()).groupBy(*keys, member).agg(F.median(value).alias("value"))
    w = Window.partitionBy(*keys)
    rows = one.withColumn("_at", F.row_number().over(w.orderBy("value", member)) - 1).withColumn("_n", F.count("*").over(w)).where(F.col("_n") > least)
    k, at, n = F.floor((F.col("_n") - 2) / 2), F.col("_at"), F.col("_n")

    def middle(pick, own: Column) -> Column:
        """The median without the row at place ``own``; ``pick(i)`` is the value at place k + i."""
        first = F.when(own > k, pick(0)).otherwise(pick(1))
        second = F.when(own > k + 1, pick(1)).otherwise(pick(2))
        return F.when(n % 2 == 0, first).otherwise((first + second) / 2)

    around = {f"_a{i}": F.max(F.when(at == k + i, F.col("value"))).over(w) for i in range(3)}
    ends = {"_lo": F.min("value").over(w), "_lo2": F.max(F.when(at == 1, F.col("value"))).over(w), "_hi": F.max("value").over(w), "_hi2": F.max(F.when(at == n - 2, F.col("value"))).over(w)}
    rows = rows.withColumns(around | ends).withColumn("median", middle(lambda i: F.col(f"_a{i}"), at))
    high, low = F.when(at == n - 1, F.col("_hi2")).otherwise(F.col("_hi")), F.when(at == 0, F.col("_lo2")).otherwise(F.col("_lo"))
    rows = rows.select(*keys, member, "value", "median", "_n", low.alias("low"), high.alias("high"))
    centres = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("median").alias("_c")).distinct()
    far = rows.join(centres, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]).withColumn("_far", F.abs(F.col("value") - F.col("_c")))
    w = Window.partitionBy(*keys, "_c")
    far = far.withColumn("_at", F.row_number().over(w.orderBy("_far", member)) - 1)
    far = far.withColumns({f"_a{i}": F.max(F.when(at == k + i, F.col("_far"))).over(w) for i in range(3)}).where(F.col("median") == F.col("_c"))
    mad = middle(lambda i: F.col(f"_a{i}"), at) * MAD_SCALE
    return far.select(*keys, member, "value", (F.col("_n") - 1).alias("n"), "median", mad.alias("mad"), "low", "high", (F.col("high") - F.col("low")).alias("spread"))


def judge_level(direction: Column, value: Column, median: Column, mad: Column, spread: Column, width: Column) -> Column:
    """narrow_band, extreme_threshold or null, from a requirement and its peers.

    A band is only tested for being narrow, if peers differ at all. Otherwise the z of the value, in the direction that
    makes the requirement stricter, must reach 3, and peers must differ by 5 % of their median.
    """
    narrow = F.when((spread > 0) & (width / spread <= 0.25), "narrow_band")
    flat = (mad <= 0) | (mad < 0.05 * F.abs(median))
    strict = F.when(~flat & ((value - median) / mad * direction >= 3), "extreme_threshold")
    return F.when(width.isNotNull() & (spread > 0), narrow).when(direction.isNotNull(), strict)


def values_at(df: DataFrame, keys: list[str], value: str, places: Column) -> DataFrame:
    """(keys, n, at, value): the values at some places of each group's sorted values, for groups of any size.

    ``places`` is an array of places from 0, in terms of the column ``n``. Values keep their type, which
    may be any that is ordered: numbers, decimals, dates, strings. Equal ones are counted where the rows
    are; distinct ones are cut into ranges by sampled splitters over (keys, value), so a group of any size is spread; and only
    ranges that hold a place are sorted. Null values are left out; a null key is a group.
    """
    from awardgrid.operators.matching import written

    own = [f"_k{i}" for i in range(len(keys))]
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in own] + [F.col(f"{a}._range") == F.col(f"{b}._range")]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(keys, own, strict=True)], F.col(value).alias("_v"))
    counted = rows.groupBy(*own, "_v").agg(F.count("*").alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counted.repartitionByRange(parts, *own, "_v").withColumn("_range", F.spark_partition_id()), "ranged")
    whole = Window.partitionBy(*own)  # over a row for each range of the group
    before = F.coalesce(F.sum("_s").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy(*own, "_range").agg(F.sum("_c").alias("_s")).withColumns({"_before": before, "n": F.sum("_s").over(whole)})
    asked = sizes.withColumn("at", F.explode(F.array_distinct(F.transform(places, lambda x: x.cast("long"))))).where("_before <= at and at < _before + _s")
    asked = written(asked.select(*own, "_range", "n", "at", (F.col("at") - F.col("_before")).alias("_inside")), "asked")
    upto = F.sum("_c").over(Window.partitionBy(*own, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = ranged.alias("r").join(asked.select(*own, "_range").distinct().alias("q"), same("r", "q"), "left_semi").withColumn("_upto", upto)
    found = near.alias("r").join(asked.alias("q"), same("r", "q")).where("_upto - _c <= _inside and _inside < _upto")
    return found.select(*[F.col(f"r.{k}").alias(c) for c, k in zip(keys, own, strict=True)], F.col("n").alias("n"), F.col("at").alias("at"), F.col("_v").alias(value))


def interpolated(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, and a column for each name in ``shares``): quantiles between neighbouring values, for groups of any size."""
    at = {name: F.lit(p) * (F.col("n") - 1) for name, p in shares.items()}
    found = values_at(df, keys, value, F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at.values()])))
    ends = {}
    for name, x in at.items():
        ends |= {f"_a_{name}": F.max(F.when(F.col("at") == F.floor(x), F.col(value))), f"_b_{name}": F.max(F.when(F.col("at") == F.ceil(x), F.col(value)))}
    ends = found.groupBy(*keys, "n").agg(*[c.cast("double").alias(n) for n, c in ends.items()])
    return ends.select(*keys, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * (x - F.floor(x))).alias(n) for n, x in at.items()])


def large_group_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median) for few groups of any size."""
    middle = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    return values_at(df.withColumn(value, F.col(value).cast("double")), keys, value, middle).groupBy(*keys, "n").agg(F.avg(value).alias("median"))


def nearest_rank_quantiles(df: DataFrame, keys: list[str], value: str, shares=(0.0, 0.25, 0.5, 0.75, 1.0), task_values: int = TASK_VALUES) -> DataFrame:
    """The values at index min(int(p * n), n - 1) of each group's sorted values, one row for each share.

    Values are of any ordered type and keep it. Groups are counted first: with over ``task_values`` values
    in any, see ``values_at``; else a task sorts each.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    place = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    if _largest(rows, keys) > task_values:
        found = values_at(rows, keys, value, F.array(*[place(p) for p in shares]))
    else:
        w = Window.partitionBy(*keys)
        found = rows.withColumn("at", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    share = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), place(p).alias("at")) for p in shares])).alias("_share")
    wanted = found.where(F.array_contains(F.array(*[place(p) for p in shares]), F.col("at").cast("long")))
    return wanted.select(*keys, "n", "at", F.col(value).alias("quantile"), share).where("_share.at = at").select(*keys, "_share.p", "quantile", "n")


def share_histogram(df: DataFrame, key: str) -> DataFrame:
    """Counts of a column's values with their percentage of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(key, "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def depth_histogram(df: DataFrame, label: str, member: str, steps=(2, 4, 6, 8, 12, 20, 30)) -> DataFrame:
    """How many labels have at least so many distinct members, and how many members those cover."""
    depth = df.groupBy(label).agg(F.count_distinct(member).alias("members"))
    step = F.explode(F.array(*[F.lit(s) for s in steps])).alias("least")
    labels = depth.select("members", step).where("members >= least").groupBy("least").agg(F.count("*").alias("labels"))
    covered = df.join(depth, label).select(member, "members", step).where("members >= least").groupBy("least").agg(F.count_distinct(member).alias("covered"))
    return labels.join(covered, "least")


def precision_recall(df: DataFrame, expected: Column, found: Column, keys: list[str] | None = None) -> DataFrame:
    """True and false positives and misses with precision and recall, null where nothing was found or expected."""
    e, f = expected.cast("boolean"), found.cast("boolean")
    counts = df.groupBy(*(keys or [])).agg(
        F.count_if(e & f).alias("hits"), F.count_if(~e & f).alias("false_alarms"), F.count_if(e & ~f).alias("misses")
    )
    rate = lambda b: F.when(F.col("hits") + F.col(b) > 0, F.col("hits") / (F.col("hits") + F.col(b)))
    return counts.withColumn("precision", rate("false_alarms")).withColumn("recall", rate("misses"))
