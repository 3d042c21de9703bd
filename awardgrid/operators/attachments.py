"""Attachments of notices: which can be fetched, in which order, and what was fetched already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardgrid.functions import names

# Fixed values.
DIRECT_HOST = "canadabuys.canada.ca"
GOODS = ("GD",)
PRIORITY = (
    (0, r"annex|appendi|spec|sow|statement[_-]?of[_-]?work|technical|requirement|exigence|devis|attach"),
    (1, r"rfp|rfq|itq|ital|rfsa|acan|solicit|tender|invitation"),
    (3, r"amend|modif|addend|revis"),
    (4, r"form|certif|checklist|pricing|price|questionnaire"),
)
ROLES = (
    ("amendment", r"amend|modif|addend|revis"),
    ("spec", r"annex|appendi|spec|sow|statement[_-]?of[_-]?work|technical|requirement|exigence|devis"),
    ("solicitation", r"rfp|rfq|itq|ital|rfsa|acan|pwgsc|solicit|tender|invitation"),
    ("form", r"form|certif|checklist|bid[_-]?submis|pricing|price"),
)
BREAKS = r"[,;|\s]+"


def _urls(cell: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(cell, F.lit(""))), BREAKS), lambda u: u.startswith("http"))


def attachment_urls(cell: Column) -> Column:
    """The links of a cell that can be fetched directly, once each, in their order."""
    return F.array_distinct(F.filter(_urls(cell), lambda u: F.contains(u, F.lit(DIRECT_HOST))))


def attachment_kind(cell: Column) -> Column:
    """none, direct or portal: whether any link of a cell can be fetched directly."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    return F.when(F.length(text) < 10, "none").when(F.exists(_urls(cell), lambda u: F.contains(u, F.lit(DIRECT_HOST))), "direct").otherwise("portal")


def host_counts(notices: DataFrame) -> DataFrame:
    """Links by host, of cells that aren't empty."""
    rows = notices.where(F.length(F.trim("attachment")) >= 10).select(F.explode(_urls(F.col("attachment"))).alias("u"))
    return rows.groupBy(F.regexp_replace("u", r"^https?://([^/]+).*", "$1").alias("host")).agg(F.count("*").alias("links"))


def _cascade(text: Column, steps, last) -> Column:
    out = None
    for value, pattern in steps:
        hit = text.rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(last)


def attachment_rank(url: Column) -> Column:
    """The order that a tender's links are fetched in: specifications first."""
    return _cascade(F.lower(F.substring_index(url, "/", -1)), PRIORITY, 2)


def document_role(name: Column) -> Column:
    """amendment, spec, solicitation, form or other, by the first pattern that the name has."""
    return _cascade(F.lower(name), ROLES, "other")


def scan_candidates(notices: DataFrame, scope: list[str] | None = None, references: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, counts): tenders whose attachments can be fetched, and how many each category has.

    Goods with a direct link and a code; references asked for by name needn't be goods. counts:
    unspsc4, tenders, label (of the first one in the feed), over all categories; candidates are those of
    ``scope``. notices: reference, solicitation, pub_date, method, title, category, unspsc, unspsc_desc,
    attachment, row_seq.
    """
    named = F.trim("reference").isin(*references) if references else F.lit(False)
    goods = F.arrays_overlap(names.categories(F.col("category")), F.array(*[F.lit(g) for g in GOODS]))
    code = names.first_code(F.col("unspsc"))
    rows = notices.where((named | goods) & F.contains(F.coalesce("attachment", F.lit("")), F.lit(DIRECT_HOST)) & code.isNotNull())
    label = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("unspsc_desc", F.lit("")), r"\*", " "), r"\s+", " ")), 1, 48)
    rows = rows.withColumns({"unspsc4": F.substring(code, 1, 4), "unspsc8": F.substring(code, 1, 8), "label": label, "urls": attachment_urls(F.col("attachment"))})
    counts = rows.groupBy("unspsc4").agg(F.count("*").alias("tenders"), F.min_by("label", "row_seq").alias("label"))
    found = rows if not scope else rows.where(F.col("unspsc4").isin(*scope))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return found.where(F.size("urls") > 0).select(
        "unspsc4", "unspsc8", *[text(F.col(c)).alias(c) for c in ("reference", "solicitation", "pub_date", "method")], F.substring(text(F.col("title")), 1, 160).alias("title"), "urls"
    ), counts


def pick(candidates: DataFrame, per_category: int, order: str = "recent") -> DataFrame:
    """At most so many tenders of each category: the most recent, the oldest, or evenly spread ones. 0: all."""
    rows = candidates.where(F.col("reference") != "")
    w = Window.partitionBy("unspsc4")
    by = [F.desc("pub_date"), F.desc("reference")] if order == "recent" else [F.asc("pub_date"), F.asc("reference")]
    rows = rows.withColumn("_at", F.row_number().over(w.orderBy(*by)) - 1).withColumn("_n", F.count("*").over(w))
    if per_category > 0 and order == "spread":
        cut = F.ceil((F.col("_at") + 1) * per_category / F.col("_n")) > F.ceil(F.col("_at") * per_category / F.col("_n"))
        rows = rows.where((F.col("_n") <= per_category) | cut)
    elif per_category > 0:
        rows = rows.where(F.col("_at") < per_category)
    return rows.drop("_at", "_n")


def fetch_list(candidates: DataFrame, most: int = 0) -> DataFrame:
    """(unspsc4, reference, url, nth, file_name) in the order to fetch: a tender's links by rank, ``most`` of each."""
    links = candidates.select("unspsc4", "reference", F.posexplode("urls").alias("i", "url")).withColumn("rank", attachment_rank(F.col("url")))
    nth = F.row_number().over(Window.partitionBy("unspsc4", "reference").orderBy("rank", "i"))
    rows = links.withColumn("nth", nth)
    rows = rows.where(F.col("nth") <= most) if most else rows
    return rows.select("unspsc4", "reference", "url", "rank", "nth", names.url_filename(F.col("url"), F.col("nth")).alias("file_name"))


def not_fetched(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Links that the manifest doesn't know as fetched: its last row for a url has no error and a file with bytes.

    manifest: seq, url, local_path, bytes, error.
    """
    last = manifest.groupBy("url").agg(F.max(F.struct("seq", "local_path", "bytes", "error")).alias("m"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    done = last.where((text("m.error") == "") & (text("m.local_path") != "") & (F.coalesce(F.col("m.bytes").cast("long"), F.lit(0)) > 0))
    return wanted.join(done.select("url"), "url", "left_anti")


def category_depth(notices: DataFrame, digits: int = 4, least: int = 30, most: int = 20) -> DataFrame:
    """The categories with most usable tenders (goods, a direct link, a code): a top-k report."""
    _, counts = scan_candidates(notices) if digits == 4 else (None, _by_digits(notices, digits))
    return counts.where(F.col("tenders") >= least).orderBy(F.desc("tenders"), F.desc("unspsc4")).limit(most)


def _by_digits(notices: DataFrame, digits: int) -> DataFrame:
    code = names.first_code(F.col("unspsc"))
    usable = F.arrays_overlap(names.categories(F.col("category")), F.array(*[F.lit(g) for g in GOODS])) & F.contains(F.coalesce("attachment", F.lit("")), F.lit(DIRECT_HOST))
    rows = notices.where(usable & (F.length(code) >= digits))
    return rows.groupBy(F.substring(code, 1, digits).alias("unspsc4")).agg(F.count("*").alias("tenders"))
