"""Readers of notice and award feeds, document folders and case logs, and the queue's sinks."""

from __future__ import annotations

import csv
import datetime
import html
import io
import json
import os
import re
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from awardgrid.sources.quoted import read_records


def read_feed(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """A CSV feed with quoted line breaks, read in parallel (``quoted.read_records``); all columns are strings, a
    byte-order mark is dropped, blanks are null. Each file begins with the header, which the first file's decides.
    ``order`` adds a column that ascends with the place in the feed, files by name."""
    from awardgrid.operators.matching import written

    records = written(read_records(spark, path), "feed")
    first = records.groupBy("file").agg(F.min("position").alias("header"))
    files = F.broadcast(first.withColumn("number", F.row_number().over(Window.orderBy("file"))))  # a row for each file
    head = records.join(files.where("number = 1"), "file").where("position = header").select(F.regexp_replace("record", "^\ufeff", "").alias("record")).first()
    if head is None:
        raise ValueError(f"no header in {path}")
    names = next(csv.reader(io.StringIO(head["record"], newline="")))
    kinds = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records.join(files, "file").where("position > header")
    cells = rows.select(F.from_csv("record", kinds, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "lineSep": "\0"}).alias("r"), F.shiftleft(F.col("number").cast("long"), 44).alias("n"), "position")
    blank = lambda i: F.col("r")[f"c{i}"]
    return cells.select(*[F.when(F.trim(blank(i)) != "", blank(i)).alias(name) for i, name in enumerate(names)], *([(F.col("n") + F.col("position")).alias(order)] if order else []))


def read_notices(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Notices with our column names (ours: the feed's). Rows without a reference go; of several with one, the last stays."""
    feed = read_feed(spark, path, "_seq")
    rows = feed.select(*[F.col(f"`{theirs}`").alias(ours) if theirs in feed.columns else F.lit(None).cast("string").alias(ours) for ours, theirs in columns.items()], "_seq")
    last = rows.where("reference is not null").groupBy("reference").agg(F.max("_seq").alias("_seq"))
    return rows.join(last, ["reference", "_seq"], "left_semi").withColumnRenamed("_seq", "row_seq")


#: What a lower-cased header must contain to be an award column, in order of preference.
AWARD_COLUMNS = {
    "reference": (("referencenumber",),),
    "solicitation": (("solicitationnumber",),),
    "supplier": (("supplier", "standard", "name"), ("supplier", "legal", "name"), ("supplier", "name")),
    "buyer": (("contractingentityname",), ("entity", "name")),
    "value": (("totalcontractvalue",), ("contractamount",), ("contract", "value")),
    "award_date": (("contractawarddate",), ("awarddate",)),
    "postal": (("supplier", "postalcode"),),
    "city": (("supplier", "city"),),
}


def detect_columns(header: list[str]) -> dict[str, str]:
    """Our award columns among a feed's; French ones are left out.

    Raises if supplier, buyer, or both solicitation and reference are missing.
    """
    plain = [h for h in header if not re.search(r"-fra\b|fra$", h, re.I)]
    found = {}
    for ours, wishes in AWARD_COLUMNS.items():
        hits = (h for wish in wishes for h in plain if all(w in h.lower() for w in wish))
        if hit := next(hits, None):
            found[ours] = hit
    found |= {ours: hit for ours, test in (("unspsc", lambda h: h.strip('"\ufeff') == "unspsc"), ("title", lambda h: h.startswith("title"))) if (hit := next((h for h in plain if test(h.lower())), None))}
    if "supplier" not in found or "buyer" not in found or not ({"solicitation", "reference"} & found.keys()):
        raise ValueError(f"not an award feed: {header}")
    return found


def read_awards(spark: SparkSession, path: str) -> DataFrame:
    feed = read_feed(spark, path)
    return feed.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in detect_columns(feed.columns).items()], F.monotonically_increasing_id().alias("row_seq"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(category, reference, document, text) of ``<category>/<reference>__<file>.txt`` below a folder."""
    rows = spark.read.text(f"{root}/*/*.txt", wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return rows.select(
        F.element_at(F.split("path", "/"), -2).alias("category"), F.substring_index(name, "__", 1).alias("reference"),
        F.regexp_replace(F.regexp_replace(name, r"^.*?__", ""), r"\.txt$", "").alias("document"), "text",
    )


def read_cases(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """The case log's readable lines, and how many aren't. Blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("c"))
    return rows.where("c._corrupt is null").select("c.*").drop("_corrupt"), rows.where("c._corrupt is not null").count()


def file_kind(content: Column) -> Column:
    """pdf, zip, ole, rtf, png, jpg, html or unknown by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 480), "ISO-8859-1")))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0"), "ole").when(head.startswith("7B5C727466"), "rtf")
        .when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg")
        .when(text.startswith("<!doctype html") | text.startswith("<html") | F.contains(F.substring(text, 1, 400), F.lit("<head")), "html").otherwise("unknown")
    )


# Fixed values.
ENDINGS = {"pdf": ".pdf", "docx": ".docx", "xlsx": ".xlsx", "pptx": ".pptx", "zip": ".zip", "ole": ".doc", "rtf": ".rtf", "png": ".png", "jpg": ".jpg"}
ZIP_FOLDERS = (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"))


def zip_flavour(content: Column) -> Column:
    """docx, xlsx, pptx or zip by the names in an archive; zip if it can't be read."""

    def kind(blob: bytes | None) -> str | None:
        if blob is None:
            return None
        try:
            held = zipfile.ZipFile(io.BytesIO(blob)).namelist()
        except Exception:  # whatever a damaged archive raises
            return "zip"
        return next((k for folder, k in ZIP_FOLDERS if any(n.startswith(folder) for n in held)), "zip")

    return F.pandas_udf(lambda s: s.map(kind), "string")(content)


def retyped_name(name: Column, kind: Column) -> Column:
    """A file's name with the ending that its kind has; unknown kinds keep theirs."""
    want = F.try_element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), kind)
    own = F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1)
    return F.when(want.isNull() | (F.lower(own) == want), name).otherwise(F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(own)), want))


def office_text(content: Column, kind: Column) -> Column:
    """The text of a docx (body, headers, footers) or xlsx (shared strings), null for other kinds and unreadable files."""
    tag = re.compile("<[^>]+>")

    def read(blob: bytes | None, of: str | None) -> str | None:
        if blob is None or of not in ("docx", "xlsx"):
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(blob)) as z:
                if of == "xlsx":
                    return tag.sub("", z.read("xl/sharedStrings.xml").decode("utf-8", "replace").replace("</si>", "\n")) if "xl/sharedStrings.xml" in z.namelist() else ""
                parts = []
                for name in sorted(n for n in z.namelist() if n == "word/document.xml" or re.match(r"word/(?:header|footer)\d*\.xml$", n)):
                    body = z.read(name).decode("utf-8", "replace").replace("</w:p>", "\n").replace("</w:tc>", "\t")
                    parts.append(tag.sub("", re.sub(r"<w:br[^>]*/>", "\n", re.sub(r"<w:tab[^>]*/>", "\t", body))))
                return html.unescape("\n".join(parts))
        except Exception:  # whatever a damaged archive raises
            return None

    import pandas as pd

    return F.pandas_udf(lambda c, k: pd.Series([read(a, b) for a, b in zip(c, k, strict=True)], dtype=object), "string")(content, kind)


def extracted_text(spark: SparkSession, files: DataFrame, cache: str) -> DataFrame:
    """(path, kind, text) of files (path, content) through a table of texts that were read before.

    Only files that the table lacks are read; their texts are appended to it. PDF needs a parser that
    isn't here, so such texts come from the table alone.
    """
    try:
        held = spark.read.parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], "path string, kind string, text string")
    new = files.join(held.select("path"), "path", "left_anti").withColumn("kind", file_kind(F.col("content")))
    new = new.withColumn("kind", F.when(F.col("kind") == "zip", zip_flavour(F.col("content"))).otherwise(F.col("kind")))
    text = F.when(F.col("kind") == "html", html_text(F.decode("content", "UTF-8"))).otherwise(office_text(F.col("content"), F.col("kind")))
    new.select("path", "kind", text.alias("text")).where("text is not null").write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(files.select("path"), "path", "left_semi")


def pdf_pages(content: Column) -> Column:
    """Page objects in a PDF's bytes: /Type /Page without /Pages."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit("/Type ?/Page(?!s)"))


def html_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags, blanks squeezed."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?s)<[^>]*>", " "), r"\s+", " "))


def write_queue(queue: DataFrame, path: str) -> None:
    """The ranked queue as JSON with all it holds, as CSV with its plain columns, and as HTML."""
    queue.write.mode("overwrite").json(f"{path}/json")
    plain = [f.name for f in queue.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    queue.select(*plain).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    queue.select(case_html(queue).alias("value")).write.mode("overwrite").text(f"{path}/html")


def case_html(queue: DataFrame) -> Column:
    """A case as a section of a page: what the columns of a queue hold, escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = lambda c, default="": safe(F.coalesce(F.col(c).cast("string"), F.lit(default))) if c in queue.columns else F.lit(default)
    body = F.replace(cell("narrative"), F.lit("\n"), F.lit("<br>"))
    return F.concat(F.lit('<section class="'), cell("route"), F.lit('"><h2>'), cell("reference"), F.lit(" "), cell("title"), F.lit("</h2><p>score "), cell("score", "0"), F.lit("</p><p>"), body, F.lit("</p></section>"))


# ---- small files and logs -------------------------------------------------------------------------

OBSERVATION = (
    "reference string, unspsc8 string, pub_date string, label string, raw_label string, label_src string, comparator string, comp_src string, value string, value_text string, unit string, unit_resolved string, dimension string, "
    "base_value double, base_unit string, value_lo double, value_hi double, base_lo double, base_hi double, band_width double, restated int, also_stated_as string, soft_unit boolean, part_number_line boolean, scope string, file string, "
    "line_no int, section string, source_line string, context string, run_id string"
)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations as ``write_observations`` left them, typed; blanks are null."""
    return spark.read.schema(OBSERVATION).options(header=True, multiLine=True, escape='"', enforceSchema=False).csv(path)


def write_observations(rows: DataFrame, path: str) -> None:
    """The 30 columns of observations and their run as CSV; missing columns are blank."""
    wanted = [f.split() for f in OBSERVATION.split(", ")]
    rows.select(*[F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in wanted]).write.mode("overwrite").options(header=True, escape='"').csv(path)


def notice_meta(notices: DataFrame, references: DataFrame) -> DataFrame:
    """(reference, unspsc8, pub_date) of the notices that a table of references names."""
    from awardgrid.functions.names import first_code

    rows = notices.select("reference", F.coalesce(F.substring(first_code(F.col("unspsc")), 1, 8), F.lit("")).alias("unspsc8"), F.substring(F.trim(F.coalesce("published", F.lit(""))), 1, 10).alias("pub_date"))
    return rows.join(references.select("reference").distinct(), "reference", "left_semi")


def replace_if_plausible(path: str, new: str, column: str, least: float = 0.9) -> str:
    """Put a new feed in the place of an old one if its header has the column and it isn't much smaller.

    The old one is kept in ``previous/``. Says what was done; raises where the new file won't do. For
    single files on the driver.
    """
    old, got = Path(path), Path(new)
    with got.open(encoding="utf-8-sig", errors="replace") as f:
        if column not in f.readline():
            raise ValueError(f"{new} has no column {column}")
    if old.exists():
        if got.stat().st_size < least * old.stat().st_size:
            raise ValueError(f"{new} has {got.stat().st_size} bytes, {path} {old.stat().st_size}")
        (old.parent / "previous").mkdir(exist_ok=True)
        os.replace(old, old.parent / "previous" / old.name)
        os.replace(got, old)
        return "replaced"
    os.replace(got, old)
    return "new"


def load_map(path: str) -> dict[str, str]:
    """The frozen label map; none is an empty one, an unreadable one stops everything."""
    if not os.path.exists(path):
        return {}
    try:
        held = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise SystemExit(f"{path} is unreadable ({e}); it is frozen, mend or move it by hand") from e
    return held.get("map", held)


def save_map(mapping: dict[str, str], meta: dict, path: str) -> None:
    """Write the whole map beside the old one, then put it in its place."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path + ".tmp").write_text(json.dumps({"meta": meta, "map": dict(sorted(mapping.items()))}, indent=1, ensure_ascii=False), encoding="utf-8")
    os.replace(path + ".tmp", path)


def write_settings(path: str, run_id: str, settings: dict, references: list[str] = ()) -> None:
    """A batch's settings, written before any of its tenders."""
    plain = {k: v for k, v in settings.items() if v is None or isinstance(v, (str, int, float, bool, list))}
    Path(path).mkdir(parents=True, exist_ok=True)
    told = {"run_id": run_id, "written": datetime.datetime.now(datetime.timezone.utc).isoformat(), "settings": plain, "references": list(references)}
    Path(path, f"{run_id}_settings.json").write_text(json.dumps(told, indent=1), encoding="utf-8")


def known_groups(spark: SparkSession, root: str) -> list[str]:
    """The categories below a folder that have a knowledge base with events."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/events")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().getParent().getName() for x in found or [])


USAGE = "ts string, provider string, model string, tag string, prompt_tokens string, completion_tokens string, total_tokens string, cached string"


def read_log(spark: SparkSession, path: str, schema: str = USAGE) -> DataFrame:
    """A log of model calls; NUL bytes that a crash left are dropped."""
    lines = spark.read.text(path).select(F.translate("value", "\x00", "").alias("value")).where(F.col("value") != "")
    first = ",".join(f.split()[0] for f in schema.split(", "))
    return lines.where(F.col("value") != first).select(F.from_csv("value", schema).alias("r")).select("r.*")


def usage_by_agent(log: DataFrame, today: str, names: dict[str, str] | None = None) -> DataFrame:
    """Per agent and day: calls, cached ones, tokens paid (none for a cached answer), today's calls, the last call."""
    told = F.create_map(*[F.lit(x) for kv in (names or {"": "other"}).items() for x in kv])
    tag = F.coalesce("tag", F.lit(""))
    cached = F.coalesce(F.col("cached") == "1", F.lit(False))
    tokens = F.when(cached, 0).otherwise(F.coalesce(F.expr("cast(try_cast(total_tokens as double) as long)"), F.lit(0)))
    rows = log.select(F.coalesce(F.try_element_at(told, tag), F.when(tag != "", tag), F.lit("other")).alias("agent"), F.substring("ts", 1, 10).alias("day"), "ts", cached.alias("cached"), tokens.alias("tokens"))
    return rows.groupBy("agent", "day").agg(F.count("*").alias("calls"), F.count_if("cached").alias("cached"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last")).withColumn("today", F.col("day") == today)
