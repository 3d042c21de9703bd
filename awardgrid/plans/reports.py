"""More registered queries: predicates, reports, evaluation and review over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from awardgrid.operators import awards, scoring, screening, selection
from awardgrid.plans.registry import _CASES, _LINES, _cases, _lines, query, t


@query("SELECT l_orderkey, count(*) AS lines, count_if(l_discount > 0.05) / count(*) AS share FROM lineitem GROUP BY 1")
def within_document_share(spark, sf_dir):
    """The share of two-sided rows in a document."""
    return t(spark, sf_dir, "lineitem")[0].groupBy("l_orderkey").agg(F.count("*").alias("lines"), (F.count_if(F.col("l_discount") > 0.05) / F.count("*")).alias("share"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, count_if(o_orderstatus = 'F') / count(*) AS closed FROM orders GROUP BY 1")
def date_spread(spark, sf_dir):
    """A10: rows by year."""
    return t(spark, sf_dir, "orders")[0].groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("closed")
    )


_STATE = "st AS (SELECT user_id, event_type AS status, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1)"


def _state(spark, sf_dir):
    from awardgrid.streaming.knowledge_base import last_event

    return last_event(t(spark, sf_dir, "events")[0], "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", F.col("event_type").alias("status"), "event_id", "value")


@query("SELECT o_orderstatus, count_if(o_orderpriority LIKE '1-%') AS p1, count_if(o_orderpriority LIKE '2-%') AS p2, count_if(o_orderpriority LIKE '3-%') AS p3, max(o_totalprice) AS most FROM orders GROUP BY 1")
def demo_matrix(spark, sf_dir):
    """Cases by setup in columns."""
    p = F.substring("o_orderpriority", 1, 1)
    return t(spark, sf_dir, "orders")[0].groupBy("o_orderstatus").agg(*[F.count_if(p == str(i)).alias(f"p{i}") for i in (1, 2, 3)], F.max("o_totalprice").alias("most"))


@query("""WITH g AS (SELECT source, count(*) AS sampled, count_if(n_chars > 1500) AS rich FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT source, count(*) AS total FROM documents GROUP BY 1)
          SELECT source, sampled, rich, total, total * rich / sampled AS projected FROM g JOIN n USING (source)""")
def rate_projection(spark, sf_dir):
    """A rate measured on some rows, projected to all."""
    d = t(spark, sf_dir, "documents")[0]
    rows = d.groupBy("source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("sampled"), F.count_if((F.col("doc_id") % 2 == 0) & (F.col("n_chars") > 1500)).alias("rich"), F.count("*").alias("total"))
    return rows.where("sampled > 0").withColumn("projected", F.col("total") * F.col("rich") / F.col("sampled"))


