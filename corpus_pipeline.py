"""Documents to packed training sequences in five stages, each written and reread as the next one's input.

Language ID drops documents without a language; of each group of near-duplicates (five words, 0.8)
the one with the least id stays; documents that hold a benchmark item go; secrets are replaced in the
text; what is left is packed into sequences. All but the last return the columns of documents.

Documents have the columns in ``COLUMNS``; without one of them a stage raises, others are dropped. Null ids are kept and
never linked, since a stage drops documents by their id; rows that share an id go together. Of rows with the same id and
text one is kept. Null, empty and letterless texts end at the first stage; an empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm import decontamination, language, near_dedup, packing, secrets
from awardgrid.llm.common import Scratch, parquet

FEW_IDS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose ids aren't in a written table; that one is broadcast only while it is small."""
    gone = gone.select("doc_id")
    return docs.join(F.broadcast(gone) if gone.count() <= FEW_IDS else gone, "doc_id", "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a predicted language; null or letterless texts have none."""
    profiles = language.fit_profiles(docs)
    found = language.identify(docs, profiles, keep=COLUMNS[1:])
    return found.where(F.col("lang_pred") != "und").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group; of repeated rows, one."""
    scratch = Scratch(spark, "pipeline-near")
    found = scratch.keep(near_dedup.near_duplicates(spark, docs).select("doc_id", "kept"), "found")
    left = without(docs, found.where("not kept"))
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return (left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = decontamination.find_contamination(spark, docs, parquet(spark, sf_dir, "benchmark"))
    found = Scratch(spark, "pipeline-leaks").keep(found.select("doc_id").distinct(), "found")
    return without(docs, found).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the text; no document goes."""
    found = secrets.scan_secrets(docs, keep=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, as op3 returns them."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: No stage but the decontamination's last step is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
