"""Numeric requirements of documents: lines, sections, harvest and cleaning.

A document's lines are rows; what a line needs from its neighbours comes from windows over
(document, line number), so a long document is sorted and spilled by the shuffle, not held.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardgrid.functions import measures as M
from awardgrid.operators.matching import written
from awardgrid.operators.selection import spread

NEAR, CONTEXT = 2, 3


def line_table(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, line): trimmed lines that aren't blank or page numbers, numbered from 0 among themselves."""
    raw = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\f\x0B\x85  ]")).alias("at", "line"))
    body = raw.withColumn("line", F.trim(F.regexp_replace("line", r"^[\s ]+|[\s ]+$", ""))).where((F.col("line") != "") & ~F.col("line").rlike(M.PAGE_NUMBER))
    return body.withColumn("line_no", F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).drop("at")


def with_sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds heading (bool), section (the last heading at or above), in_scope and scope (section or whole).

    A bare structural marker is joined with a heading in the next two lines. Administrative headings
    close the requirement part, requirement headings open it, other structural ones close it; a
    document without a requirement heading counts as a whole.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    line, heading = F.col("line"), F.col("heading")
    marked = lines.withColumn("heading", M.is_heading(line))
    bare = line.rlike(M.STRUCT_HEAD) & (M.letters(F.regexp_replace(line, M.STRUCT_HEAD, "")) < 3)
    follow = F.coalesce(*[F.when(F.lead(heading, k).over(w), F.lead(line, k).over(w)) for k in (1, 2)])
    title = F.when(heading, F.when(bare & follow.isNotNull(), F.concat(line, F.lit(" - "), follow)).otherwise(line))
    titled = marked.withColumn("title", title)
    t = F.col("title")
    state = F.when(t.rlike(M.ADMIN_HEAD), False).when(t.rlike(M.SPEC_HEAD), True).when(t.rlike(M.STRUCT_HEAD), False)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = titled.withColumn("state", state).withColumn("section", F.substring(F.last("title", True).over(upto), 1, 90))
    inside = F.coalesce(F.last("state", True).over(upto), F.lit(False))
    found = F.coalesce(F.max("state").over(Window.partitionBy(*keys)), F.lit(False))
    return out.withColumn("scope", F.when(found, "section").otherwise("whole")).withColumn("in_scope", ~found | inside).drop("state", "title")


def harvest(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per value on a requirement line: label, comparator, number, unit, place and context.

    A comparator that the line lacks comes from two lines around it; a label that it lacks from two
    lines above. If a requirement section has no value at all, the whole document is read.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    line = F.col("line")
    shaped = F.length(line).between(3, 300)
    lines = with_sections(line_table(docs, keys, text).withColumn("values", F.when(shaped, M.values_in(line))), keys)
    around = lambda n: F.array_join(F.collect_list("line").over(w.rowsBetween(-n, n)), " | ")
    above = lambda k: F.when(F.length(F.lag("raw", k).over(w)) <= 120, F.struct(F.lag("raw", k).over(w).alias("raw"), F.lag("own", k).over(w).alias("key")))
    up = lambda k: F.when(F.lag("own", k).over(w).isNotNull(), above(k))
    # most lines have no value: labels are read only on those that have, and on two lines above
    useful = F.when(shaped, F.when(F.size("values") > 0, ~line.rlike(M.BOILERPLATE) & ~F.coalesce(F.col("section").rlike(M.ADMIN_SECTION), F.lit(False))))
    seen = lines.withColumn("useful", F.coalesce(useful, F.lit(False)))
    asked = F.max("useful").over(w.rowsBetween(0, 2))
    seen = seen.withColumn("asked", asked).withColumn("raw", F.when(F.col("asked"), M.raw_label(line))).withColumn("own", F.when(F.col("asked"), M.label(line)))
    seen = seen.withColumn("near", around(NEAR)).withColumn("context", around(CONTEXT)).withColumn("up", F.coalesce(up(1), up(2)))
    inline = M.comparator(line)
    rows = (
        seen.where("useful").withColumn("context", F.substring(F.regexp_replace("context", r"\s+", " "), 1, 400))
        .withColumn("inline", inline).withColumn("comparator", F.when(F.col("inline") != "NONE", F.col("inline")).otherwise(M.comparator(F.col("near"))))
        .withColumn("comp_src", F.when(F.col("inline") != "NONE", "inline").when(F.col("comparator") != "NONE", "window").otherwise("none"))
        .withColumn("label_src", F.when(F.col("own").isNotNull(), "inline").when(F.col("up").isNotNull(), "above"))
        .where("label_src is not null")
        .withColumn("label", F.coalesce("own", "up.key")).withColumn("raw_label", F.substring(F.when(F.col("own").isNotNull(), F.col("raw")).otherwise(F.col("up.raw")), 1, 120))
        .select("*", F.posexplode("values").alias("nth", "v"))
        .withColumn("row_seq", F.col("line_no") * 1000 + F.col("nth"))
    )
    unit = F.col("v.unit")
    rows = rows.withColumn("unit_resolved", M.resolved_unit(unit, F.col("v.tail"))).withColumn("value", M.parse_number(F.col("v.value_text")))
    year = (unit == "A") & F.col("v.value_text").rlike(r"^(19|20)\d{2}$")
    rows = rows.where("unit_resolved is not null and value is not null").where(~year)
    kept = F.max(F.col("in_scope")).over(Window.partitionBy(*keys))
    rows = rows.withColumn("kept", kept).where("in_scope or not kept").withColumn("scope", F.when((F.col("scope") == "section") & ~F.col("kept"), "whole_empty").otherwise(F.col("scope")))
    return rows.select(
        *keys, "line_no", "row_seq", "label", "raw_label", "label_src", "comparator", "comp_src", "value", F.col("v.value_text").alias("value_text"), unit.alias("unit"), "unit_resolved",
        M.dimension(unit).alias("dimension"), unit.isin(*M.SOFT_UNITS).alias("soft_unit"), line.rlike(M.PART_NUMBER).alias("part_number_line"), "scope",
        F.coalesce("section", F.lit("")).alias("section"), "context", F.substring(F.regexp_replace("line", r"\s+", " "), 1, 200).alias("source_line"),
    )


def collapse_bands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Two different RANGE values of one label and unit on a line become their middle, with both ends kept.

    Values that are no numbers don't count as bounds. The first row of the line, by ``row_seq``, stands
    for the band. Middle and width are rounded to six places.
    """
    w = Window.partitionBy(*keys, "line_no", "label", "unit", "comparator")
    v = F.expr("try_cast(value as double)")
    low, high = F.min(v).over(w), F.max(v).over(w)
    pair = (F.col("comparator") == "RANGE") & (F.count(v).over(w) == 2) & (low < high)
    nth = F.row_number().over(w.orderBy("row_seq"))
    out = rows.withColumns({"value_lo": F.when(pair, low), "value_hi": F.when(pair, high), "_n": F.when(pair, nth).otherwise(1)}).where("_n = 1").drop("_n")
    middle = M.plain_number(F.round((F.col("value_lo") + F.col("value_hi")) / 2, 6))
    return out.withColumn("band_width", F.round(F.col("value_hi") - F.col("value_lo"), 6)).withColumn("value", F.coalesce(middle, "value"))


def convert_units(rows: DataFrame) -> DataFrame:
    """Adds base_value, base_unit and both ends in the base unit."""
    unit = F.coalesce("unit_resolved", "unit")
    out = rows.withColumn("base_value", M.to_base(F.col("value"), unit)).withColumn("base_unit", F.when(F.col("base_value").isNotNull(), M.base_unit(unit)))
    for side in ("lo", "hi"):
        out = out.withColumn(f"base_{side}", M.to_base(F.col(f"value_{side}"), unit) if f"value_{side}" in rows.columns else F.lit(None).cast("double"))
    return out


def fold_restatements(rows: DataFrame, keys: list[str], tolerance: float = 0.02) -> DataFrame:
    """Values of one label and dimension on one line that agree within 2 % are one: the metric one, met first.

    The fold is greedy and depends on the order, so a line's values are folded in one small array:
    ``aggregate`` keeps a list of survivors. Rows, in the order of ``row_seq`` within their line, that
    didn't convert pass through.
    """
    on = [*keys, "line_no", "label", "dimension"]
    other = [c for c in rows.columns if c not in on]
    plain = rows.where("base_value is null").select(*on, *other, F.lit(1).alias("restated"), F.lit("").alias("also_stated_as"))
    first = F.when(F.col("unit").isin(*M.METRIC_FIRST), 0).otherwise(1)
    row = F.struct(first.alias("_o"), F.col("row_seq").alias("_s"), *other)
    kept_type = rows.select(F.struct(F.struct(*other).alias("row"), F.lit(1).alias("restated"), F.lit("").alias("also_stated_as")).alias("k")).schema["k"].dataType.simpleString()
    plain_row = lambda r: F.struct(*[r[c].alias(c) for c in other])
    same = lambda k, r: F.abs(k["row"]["base_value"] - r["base_value"]) <= tolerance * F.greatest(F.abs(r["base_value"]), F.lit(1e-9))
    told = lambda r: F.concat(r["value"], F.lit(" "), r["unit"])

    def step(kept: Column, r: Column) -> Column:
        twin = F.array_position(F.transform(kept, lambda k: same(k, r)), F.lit(True))
        more = F.transform(kept, lambda k, i: F.when(i + 1 == twin, F.struct(k["row"].alias("row"), (k["restated"] + 1).alias("restated"), told(r).alias("also_stated_as"))).otherwise(k))
        return F.when(twin > 0, more).otherwise(F.concat(kept, F.array(F.struct(plain_row(r).alias("row"), F.lit(1).alias("restated"), F.lit("").alias("also_stated_as")))))

    grouped = rows.where("base_value is not null").groupBy(*on).agg(F.array_sort(F.collect_list(row)).alias("all"))
    folded = grouped.select(*on, F.explode(F.aggregate("all", F.array().cast(f"array<{kept_type}>"), step)).alias("k"))
    return plain.unionByName(folded.select(*on, *[F.col(f"k.row.{c}").alias(c) for c in other], "k.restated", "k.also_stated_as"))


def apply_label_map(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Renames labels; those mapped to ``unknown`` go, those without an entry stay.

    mapping: (label, canonical), the frozen label map, which the driver holds. It goes to the rows: dealt by their labels,
    which are few, most rows would meet in a few tasks.
    """
    out = rows.join(F.broadcast(mapping), "label", "left").where("canonical is null or canonical <> 'unknown'")
    return out.withColumn("label", F.coalesce("canonical", "label")).drop("canonical")


def dedup_observations(rows: DataFrame, reference: str, family: Column, order: list[Column], n: int | None = None) -> DataFrame:
    """One row per reference, family, label, value and upper end, the first in ``order``; ``restated`` counts afresh.

    Rows are dealt once, by reference and label, to as many tasks as their number ``n`` asks for (counted, if
    not given), so what is counted by both and more afterwards stays where it is.
    """
    key = F.struct(family, F.coalesce(F.col("base_value").cast("string"), "value"), F.coalesce("base_unit", "unit"), F.coalesce(F.col("base_hi").cast("string"), F.col("value_hi").cast("string") if "value_hi" in rows.columns else F.lit(None).cast("string"), F.lit("")))
    keyed = spread(rows, rows.count() if n is None else n, reference, "label").withColumn("_k", key)
    w = Window.partitionBy(reference, "label", "_k")
    return keyed.withColumn("restated", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_k", "_n")


def label_statistics(rows: DataFrame, keys: list[str], reference: str, most: int = 4) -> DataFrame:
    """Per label: tenders, rows, comparators, labels from above, converted values and their median, first and
    last date, and its most frequent raw spellings (the first by name at a tie)."""
    from awardgrid.operators.selection import top_k
    from awardgrid.operators.stats import interpolated

    on = [*keys, "dimension", "label"]
    counts = [F.count_if(F.col("comparator") == c).alias(c.lower()) for c in ("GE", "LE", "RANGE", "EQ", "NONE")]
    out = rows.groupBy(*on).agg(
        F.count_distinct(reference).alias("tenders"), F.count("*").alias("observations"), *counts, F.count_if(F.col("label_src") == "above").alias("above"),
        F.count("base_value").alias("converted"), F.min("pub_date").alias("first_date"), F.max("pub_date").alias("last_date"),
    )
    raw = top_k(rows.groupBy(*on, "raw_label").agg(F.count("*").alias("_n")), on, [F.desc("_n"), F.asc("raw_label")], most, "_r")
    raw = raw.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "raw_label"))), lambda x: x["raw_label"]).alias("spellings"))
    middle = interpolated(rows, on, "base_value", {"median_value": 0.5})
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")) for c in on])
    return out.alias("o").join(middle.alias("m"), same, "left").select("o.*", "median_value").join(raw, on, "left")


def hygiene(rows: DataFrame) -> DataFrame:
    """How observations came about: shares of sources, scopes, soft units, part numbers and unknown dimensions."""
    share = lambda c: (F.count_if(c) / F.count("*"))
    return rows.agg(
        F.count("*").alias("observations"), *[share(F.col("comp_src") == x).alias(f"comparator_{x}") for x in ("inline", "window", "none")], *[share(F.col("label_src") == x).alias(f"label_{x}") for x in ("inline", "above")],
        *[share(F.col("scope") == x).alias(f"scope_{x}") for x in ("section", "whole", "whole_empty")], share(F.col("soft_unit")).alias("soft_unit"), share(F.col("part_number_line")).alias("part_number"), share(F.col("dimension").isNull()).alias("no_dimension"),
    )


def extract_observations(docs: DataFrame, notices: DataFrame, run_id: str, group: str) -> DataFrame:
    """The observations of tenders as the knowledge base stores them: read, banded, converted, folded.

    docs: reference, document, text. notices: reference, unspsc8, pub_date. A tender without a code
    has its group's.
    """
    keys = ["reference", "document"]
    docs = docs.select(*keys, "text").repartition(*keys)  # texts are dealt once, however few tasks read them; their lines stay
    rows = fold_restatements(written(convert_units(collapse_bands(harvest(docs, keys), keys)), "observations"), keys)
    told = rows.join(notices.select("reference", "unspsc8", "pub_date"), "reference", "left")
    file = F.concat("reference", F.lit("__"), "document", F.lit(".txt"))
    return told.withColumns({"unspsc8": F.coalesce(F.when(F.col("unspsc8") != "", F.col("unspsc8")), F.lit(group)), "pub_date": F.coalesce("pub_date", F.lit("")), "run_id": F.lit(run_id), "file": file})
