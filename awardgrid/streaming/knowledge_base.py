"""The event-sourced knowledge base: append-only tables, state views, incremental batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "seq long, reference string, run_id string, pub_date string, event string, status string, pile string, score int, observations int, note string"


class KnowledgeBase:
    """Tables below one folder: observations, cases and events, appended in that order.

    A run's rows lie in a folder of their own in each table, and writing them again replaces them. An
    event is what makes a case count, and events come last: a run that stops before leaves rows that no
    view shows, and its replay writes the same folders. Once its events are there a run is over, and
    replaying it does nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}").drop("run")
        except Exception as e:  # no batch so far
            if schema is None or "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame, run_id: str) -> None:
        rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{self.root}/{name}/run={run_id}")

    def commit(self, run_id: str, observations: DataFrame, cases: DataFrame, events: DataFrame) -> bool:
        """False if this run's events are there already."""
        if not self.table("events", EVENTS).where(F.col("run_id") == run_id).isEmpty():
            return False
        self.append("observations", observations, run_id)
        self.append("cases", cases, run_id)
        self.append("events", events.coalesce(1), run_id)  # one file: there as a whole or not at all
        return True

    def record(self, run_id: str, events: DataFrame) -> bool:
        """Events without observations or cases: reviewers' verdicts."""
        if not self.table("events", EVENTS).where(F.col("run_id") == run_id).isEmpty():
            return False
        self.append("events", events.coalesce(1), run_id)
        return True

    def state(self) -> DataFrame:
        """The last event of each reference, by append order."""
        return last_event(self.table("events", EVENTS), "reference", F.desc("seq"))

    def observations(self, pile: str) -> DataFrame:
        """Observations of the run that counts for each reference in a pile."""
        now = self.state().where(F.col("pile") == pile).select("reference", "run_id")
        return self.table("observations").join(now, ["reference", "run_id"], "left_semi")

    def queue(self) -> DataFrame:
        """Cases that their reference's last event points at."""
        return self.table("cases").join(self.state().select("reference", "run_id", "pile", "status"), ["reference", "run_id"])

    def batch(self, run_ids: list[str]) -> DataFrame:
        """The cases of some runs as they were logged."""
        return self.table("cases").where(F.col("run_id").isin(*run_ids))

    def export_rows(self) -> DataFrame:
        """Raw observations of the run that counts for every tender in the base or the quarantine."""
        return self.observations("base").unionByName(self.observations("quarantine"))

    def status_counts(self) -> DataFrame:
        return self.state().groupBy("pile", "status").agg(F.count("*").alias("tenders"))


def base_rows(observations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Level-2 rows of raw observations: labels mapped, unknown ones dropped, each requirement of a tender once, converted ones only."""
    from awardgrid.operators import level2
    from awardgrid.operators.observations import apply_label_map, dedup_observations

    mapped = apply_label_map(observations, mapping)
    return level2.prepare(dedup_observations(mapped, "reference", F.substring("unspsc8", 1, 8), [F.asc("file"), F.asc("line_no"), F.asc("row_seq"), F.asc_nulls_last("base_value")], observations.count()))


def comparable_attributes(rows: DataFrame, least: int = 8, most: int = 15) -> DataFrame:
    """The attributes with enough tenders to be judged, those with most first: a top-k report."""
    counts = rows.groupBy("family", "dimension", "label").agg(F.count_distinct("reference").alias("tenders")).where(F.col("tenders") >= least)
    return counts.orderBy(F.desc("tenders"), F.desc("family"), F.desc("dimension"), F.desc("label")).limit(most)


def last_event(events: DataFrame, key: str, *order: Column) -> DataFrame:
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def work_list(notices: DataFrame, state: DataFrame, documents: DataFrame, until: str | None = None) -> DataFrame:
    """Notices to process: new ones, those registered without documents that have some now, and open ones.

    In order of publication, undated last, then reference.
    """
    known = state.select("reference", F.col("status").alias("_status"))
    have = documents.select("reference").distinct().withColumn("_doc", F.lit(True))
    rows = notices.join(known, "reference", "left").join(have, "reference", "left")
    due = F.col("_status").isNull() | ((F.col("_status") == "no_documents") & F.col("_doc").isNotNull()) | (F.col("_status") == "still_open")
    if until:
        due = due & F.coalesce(F.col("pub_date") <= until, F.lit(False))  # undated ones wait
    return rows.where(due).drop("_status", "_doc").orderBy(F.coalesce("pub_date", F.lit("9999")), "reference")


def reprocess_list(state: DataFrame, feedback: DataFrame, which: str | list[str]) -> DataFrame:
    """References to run again: named ones, the quarantine, or all; judged ones never."""
    rows = state.join(feedback.select("reference").distinct(), "reference", "left_anti")
    if isinstance(which, list):
        return rows.where(F.col("reference").isin(*which))
    return rows.where(F.col("pile") == "quarantine") if which == "quarantine" else rows


def verdict_events(state: DataFrame, feedback: DataFrame) -> DataFrame:
    """Events that reviewers' latest verdicts call for, and what is said of all of them.

    (reference, said, and an event's columns, null where nothing is to be done.) ``confirmed`` holds a
    case in the quarantine from any pile; ``clean`` moves one out of it, to the base if it had documents;
    a status that is there already calls for nothing; other verdicts and unknown references are skipped.
    """
    latest = last_event(feedback.where("reference is not null").withColumn("reference", F.trim("reference")), "reference", F.desc("seq"))
    latest = latest.select("reference", F.lower(F.trim("verdict")).alias("verdict"), F.substring("note", 1, 200).alias("_note"))
    rows = latest.join(state, "reference", "left")
    becomes = F.when(F.col("verdict") == "clean", "reviewed_clean").otherwise("confirmed")
    moved = F.when(F.col("verdict") == "confirmed", "quarantine").when(F.col("status") != "no_documents", "base").otherwise("none")
    skip = (
        F.when(~F.coalesce(F.col("verdict").isin("clean", "confirmed"), F.lit(False)), "skip: verdict must be 'clean' or 'confirmed'").when(F.col("run_id").isNull(), "skip: not in the register")
        .when(F.col("status") == becomes, "already applied").when((F.col("pile") != "quarantine") & (F.col("verdict") == "clean"), F.concat(F.lit("skip: not in quarantine (pile="), "pile", F.lit(")")))
    )
    due = lambda c: F.when(skip.isNull(), c)
    return rows.select(
        "reference", F.coalesce(skip, F.concat("verdict", F.lit(" -> "), moved)).alias("said"), due(F.col("run_id")).alias("run_id"), due(F.col("pub_date")).alias("pub_date"), due(F.lit("feedback")).alias("event"),
        due(becomes).alias("status"), due(moved).alias("pile"), due(F.col("score")).alias("score"), due(F.col("observations")).alias("observations"), due(F.col("_note")).alias("note"),
    )


def record_verdict(kb: KnowledgeBase, run_id: str, reference: str, verdict: str, note: str = "") -> str:
    """Apply one reviewer's verdict, and append its event unless it is skipped or applied already."""
    said = verdict_events(kb.state(), kb.spark.createDataFrame([(1, reference, verdict, note)], "seq long, reference string, verdict string, note string"))
    row = said.first()
    if row is None or row["run_id"] is None:
        return row["said"] if row else "skip: no reference"
    seq = kb.table("events").agg(F.max("seq")).first()[0] + 1
    kb.record(run_id, said.select(F.lit(seq).cast("long").alias("seq"), "reference", "pub_date", "event", "status", "pile", "score", "observations", "note"))
    return row["said"]


def peers_before(cases: DataFrame, key: str, order: list[str], stretch: Column, pile: str = "pile") -> DataFrame:
    """Adds ``peers_at_time``: how many cases of the key were in the base before this one.

    ``stretch`` cuts the order, as ``running`` explains.
    """
    from awardgrid.operators.selection import running

    out = running(cases, [key], [F.asc(c) for c in order], stretch, {"peers_at_time": ("count", F.when(F.col(pile) == "base", 1))})
    return out.withColumn("peers_at_time", F.coalesce("peers_at_time", F.lit(0)))


def run_stream(kb: KnowledgeBase, notices: DataFrame, evaluate: Callable[[DataFrame, KnowledgeBase], tuple[DataFrame, DataFrame, DataFrame]], checkpoint: str):
    """Processes notices as they arrive: each micro-batch is evaluated against the base as it stands and committed once."""

    def batch(rows: DataFrame, number: int) -> None:
        observations, cases, events = evaluate(rows, kb)
        kb.commit(f"batch-{number:08}", observations, cases, events)

    return notices.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
