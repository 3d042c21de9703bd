"""Registered queries over the driver's tables and their DuckDB forms.

The tables hold no procurement records, so each query applies an operator to columns of the same
shape: customers stand for buyers, suppliers for suppliers, part types for commodity groups, orders
for notices, lineitems for awards, event users for references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from awardgrid.functions import names
from awardgrid.operators import awards, matching, scoring, selection, stats
from awardgrid.sources.feeds import html_text
from awardgrid.streaming import knowledge_base as kb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, *tables: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables]


# ---------------------------------------------------------------- notices: statistics and signals

_STATS = """
m AS (SELECT o_orderpriority AS method, count(*) AS n, median(o_totalprice) AS median FROM orders GROUP BY 1 HAVING count(*) >= 20),
s AS (SELECT m.method, m.n, m.median, median(abs(o.o_totalprice - m.median)) * 1.4826 AS mad
      FROM orders o JOIN m ON o.o_orderpriority = m.method GROUP BY 1, 2, 3)"""


def _stats(orders: DataFrame) -> DataFrame:
    return stats.group_median_mad(orders.withColumnRenamed("o_orderpriority", "method"), ["method"], "o_totalprice", large=True)


@query(f"WITH {_STATS} SELECT * FROM s")
def group_window_stats(spark, sf_dir):
    """A1: per method n, median and scaled deviation, 20 values or more."""
    return _stats(*t(spark, sf_dir, "orders"))


def _signals(orders: DataFrame) -> DataFrame:
    rows = orders.join(_stats(orders), F.col("o_orderpriority") == F.col("method"), "left")
    return rows.withColumn("z", stats.z_score(F.col("o_totalprice"), F.col("median"), F.col("mad")))


@query(f"WITH {_STATS} SELECT o_orderkey, method, (o_totalprice - median) / mad AS z FROM orders JOIN s ON o_orderpriority = method WHERE mad > 0 AND (o_totalprice - median) / mad <= -1")
def short_window_signal(spark, sf_dir):
    """z of -1 or less against the own method."""
    return _signals(*t(spark, sf_dir, "orders")).where("z <= -1").select("o_orderkey", "method", "z")


_ROUTED = f"""{_STATS},
g AS (SELECT o_orderkey, CAST(o_orderstatus = 'P' AS INT) AS strong,
             CAST(coalesce(mad > 0 AND (o_totalprice - median) / mad <= -1, FALSE) AS INT) + CAST(o_orderpriority = '5-LOW' AS INT) AS weak
      FROM orders LEFT JOIN s ON o_orderpriority = method),
r AS (SELECT *, CASE WHEN strong > 0 OR weak >= 2 THEN 'deep' WHEN weak > 0 THEN 'watch' ELSE 'close' END AS route FROM g)"""


def _routed(orders: DataFrame) -> DataFrame:
    from awardgrid.operators import screening

    rows = _signals(orders).select(
        "o_orderkey", (F.col("o_orderstatus") == "P").cast("int").alias("strong"),
        (F.coalesce(F.col("z") <= -1, F.lit(False)).cast("int") + (F.col("o_orderpriority") == "5-LOW").cast("int")).alias("weak"),
    )
    return rows.withColumn("route", screening.route(F.col("strong"), F.col("weak"), F.lit(True)))


@query("""WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS pos,
                 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
          q AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS p)
          SELECT o_orderpriority, CAST(p AS DOUBLE) AS p, o_totalprice AS quantile, n FROM r, q WHERE pos = least(CAST(floor(n * p) AS BIGINT), n - 1)""")
def nearest_rank_quantiles(spark, sf_dir):
    """Values at an index of the sorted group."""
    return stats.nearest_rank_quantiles(t(spark, sf_dir, "orders")[0], ["o_orderpriority"], "o_totalprice")


@query("SELECT p_type, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM part) AS percent FROM part GROUP BY 1")
def method_histogram(spark, sf_dir):
    """Counts with percentages."""
    return stats.share_histogram(t(spark, sf_dir, "part")[0], "p_type")


@query("SELECT p_brand, count(*) AS n, count_if(p_size >= 25) AS usable, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1 HAVING count_if(p_size >= 25) >= 20")
def category_depth(spark, sf_dir):
    """Categories with enough usable members."""
    out = t(spark, sf_dir, "part")[0].groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") >= 25).alias("usable"), F.count_distinct("p_type").alias("kinds"))
    return out.where("usable >= 20")


@query("SELECT c_mktsegment, count(*) AS n, count_if(c_acctbal < 0) * 100.0 / count(*) AS missing_percent, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1")
def feed_profile(spark, sf_dir):
    """Shares and interpolated quantiles of a feed."""
    c = t(spark, sf_dir, "customer")[0]
    shares = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), (F.count_if(F.col("c_acctbal") < 0) * 100.0 / F.count("*")).alias("missing_percent"))
    return shares.join(stats.interpolated(c, ["c_mktsegment"], "c_acctbal", {"q1": 0.25, "q3": 0.75}), "c_mktsegment")


@query("""WITH r AS (SELECT l_returnflag, l_shipdate, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) - 1 AS pos, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
          q AS (SELECT unnest([0.0, 0.1, 0.5, 0.9, 1.0]) AS p)
          SELECT l_returnflag, CAST(p AS DOUBLE) AS p, CAST(l_shipdate AS VARCHAR) AS quantile, n FROM r, q WHERE pos = least(CAST(floor(n * p) AS BIGINT), n - 1)""")
def date_quantiles(spark, sf_dir):
    """Quantiles of dates in a few large groups, by ranges of values."""
    li = t(spark, sf_dir, "lineitem")[0]
    out = stats.nearest_rank_quantiles(li, ["l_returnflag"], "l_shipdate", (0.0, 0.1, 0.5, 0.9, 1.0), task_values=10_000)
    return out.withColumn("quantile", F.col("quantile").cast("string"))


# ---------------------------------------------------------------- awards

_AWARDS = "a AS (SELECT DISTINCT o_custkey AS buyer, p_type AS grp, l_orderkey AS contract, l_suppkey AS supplier FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def _ordered(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, int]:
    """Columns of order lines with their order, and the number of lines."""
    li, o = t(spark, sf_dir, "lineitem", "orders")
    n = li.count()
    li, o = (df.select(*[c for c in df.columns if c in (*columns, "l_orderkey", "o_orderkey")]) for df in (li, o))
    rows = selection.spread(li, n, "l_orderkey").join(selection.spread(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(*columns), n


def _awards(spark: SparkSession, sf_dir: str, *dealt: str) -> DataFrame:
    rows, n = _ordered(spark, sf_dir, "l_orderkey", "l_partkey", "l_suppkey", "o_custkey")
    p = t(spark, sf_dir, "part")[0].select("p_partkey", "p_type")
    rows = selection.spread(rows, n, "l_partkey").join(selection.spread(p, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("o_custkey").alias("buyer"), F.col("p_type").alias("grp"), F.col("l_orderkey").alias("contract"), F.col("l_suppkey").alias("supplier"))
    return selection.spread(rows, n, *dealt).distinct()


_SHARE = f"""{_AWARDS},
e AS (SELECT buyer, grp, supplier, count(*) AS mine FROM a GROUP BY 1, 2, 3),
c AS (SELECT *, sum(mine) OVER (PARTITION BY buyer, grp) AS total, count(*) OVER (PARTITION BY buyer, grp) AS suppliers,
             row_number() OVER (PARTITION BY buyer, grp ORDER BY mine DESC, supplier) AS rk FROM e),
h AS (SELECT buyer, grp, supplier, mine, CAST(total AS BIGINT) AS total, suppliers, mine / total AS share FROM c WHERE rk = 1 AND mine / total >= 0.5 AND total >= 3)"""


@query(f"WITH {_SHARE} SELECT * FROM h")
def repeat_share(spark, sf_dir):
    """A4: the leading supplier of a buyer's group, above the thresholds."""
    return awards.repeat_share(_awards(spark, sf_dir, "buyer", "grp"), "buyer", "grp", "supplier")


@query(f"""WITH {_AWARDS}, e AS (SELECT supplier, buyer, count(*) AS from_buyer FROM a GROUP BY 1, 2),
           c AS (SELECT *, sum(from_buyer) OVER (PARTITION BY supplier) AS total, count(*) OVER (PARTITION BY supplier) AS buyers,
                        row_number() OVER (PARTITION BY supplier ORDER BY from_buyer DESC, buyer) AS rk FROM e)
           SELECT supplier, buyer, from_buyer, CAST(total AS BIGINT) AS total, buyers, from_buyer / total AS dependency FROM c WHERE rk = 1""")
def supplier_dependency(spark, sf_dir):
    """A4, depth 2: how much of a supplier's awards come from one buyer."""
    return awards.dependency(_awards(spark, sf_dir, "supplier"), "buyer", "supplier")


_LAST = "l_orderkey, l_suppkey, l_shipdate, l_partkey, l_quantity, l_extendedprice"


@query(f"""SELECT {_LAST} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS rk FROM lineitem) WHERE rk = 1""")
def latest_award(spark, sf_dir):
    """The newest award of each contract."""
    li = t(spark, sf_dir, "lineitem")[0].select(*_LAST.split(", "))
    return selection.latest_per_key(li, ["l_orderkey"], [F.desc("l_shipdate"), *map(F.asc, ("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))])


@query("""SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY d DESC, l_suppkey) AS place
          FROM (SELECT l_orderkey, l_suppkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1, 2)""")
def distinct_winners(spark, sf_dir):
    """Each contract's winners, newest first, once each."""
    best = t(spark, sf_dir, "lineitem")[0].groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("d"))
    return best.select("l_orderkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("d"), "l_suppkey")).alias("place"))


@query("""WITH s AS (SELECT o_custkey AS buyer, l_suppkey AS supplier, o_orderkey, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
          SELECT supplier, buyer, o_orderkey, rk, n - 6 AS more FROM (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY o_orderdate DESC, o_orderkey, buyer) AS rk, count(*) OVER (PARTITION BY supplier) AS n FROM s) WHERE rk <= 6""")
def newest_awards(spark, sf_dir):
    """A supplier's newest six awards and how many more there are."""
    rows, n = _ordered(spark, sf_dir, "o_custkey", "l_suppkey", "o_orderkey", "o_orderdate")
    s = selection.spread(rows.select(F.col("o_custkey").alias("buyer"), F.col("l_suppkey").alias("supplier"), "o_orderkey", "o_orderdate"), n, "supplier").distinct()
    s = s.withColumn("more", F.count("*").over(Window.partitionBy("supplier")) - 6)
    return selection.top_k(s, ["supplier"], [F.desc("o_orderdate"), F.asc("o_orderkey"), F.asc("buyer")], 6, "rk").select("supplier", "buyer", "o_orderkey", "rk", "more")


@query("""WITH a AS (SELECT l_suppkey AS supplier, o_orderkey AS aref, o_custkey AS asol, p_name AS title, o_orderdate AS day, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
          n AS (SELECT aref AS ref, asol AS sol, supplier AS winner, upper(string_split(title, ' ')[1]) AS needle FROM (SELECT *, row_number() OVER (PARTITION BY aref ORDER BY line, supplier, title) AS i FROM a) WHERE i = 1),
          m AS (SELECT n.ref, a.aref, a.line, a.day FROM n JOIN a ON a.supplier = n.winner AND contains(lower(a.title), lower(n.needle)) AND a.aref <> n.ref AND a.asol <> n.sol),
          r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY day DESC, aref, line) AS place, count(*) OVER (PARTITION BY ref) AS total FROM m)
          SELECT k.ref, coalesce(r.total, 0) AS total, r.place, r.aref, r.line FROM (SELECT DISTINCT ref FROM n) k LEFT JOIN (SELECT * FROM r WHERE place <= 4) r ON k.ref = r.ref""")
def winner_other_awards(spark, sf_dir):
    """Other awards, by title, of the supplier of an order's first line, own order and buyer excluded; their number and the newest four."""
    li, o, p = t(spark, sf_dir, "lineitem", "orders", "part")
    lines = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_suppkey", "l_linenumber", "p_name")
    rows = lines.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = rows.select(F.col("l_suppkey").alias("supplier"), F.col("o_orderkey").alias("aref"), F.col("o_custkey").cast("string").alias("asol"), F.col("p_name").alias("title"), F.col("o_orderdate").alias("day"), F.col("l_linenumber").alias("line"))
    a = matching.written(a.withColumn("i", F.row_number().over(Window.partitionBy("aref").orderBy("line", "supplier", "title"))), "award_rows")
    n = a.where("i = 1").select(F.col("aref").alias("ref"), F.col("asol").alias("sol"), F.col("supplier").alias("winner"), F.upper(F.get(F.split("title", " "), F.lit(0))).alias("needle"))
    return awards.other_awards_of_winner(n, a.drop("i"), [F.desc("day"), F.asc("aref"), F.asc("line")]).select("ref", "total", "place", "aref", "line")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.c_custkey AS u, b.c_custkey AS v FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND abs(a.c_acctbal - b.c_acctbal) < 2 AND a.c_custkey <> b.c_custkey),
          r AS (SELECT c_custkey AS node, c_custkey AS root FROM customer UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u)
          SELECT node, min(root) AS root FROM r GROUP BY node HAVING count(*) > 1""")
def connected_spellings(spark, sf_dir):
    """Customers linked by equal nations and close balances, as components."""
    c = t(spark, sf_dir, "customer")[0]
    near = matching.near_values(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("x")), 2)
    return matching.components(spark, near)


# ---------------------------------------------------------------- peers

_PEER_SQL = """
k AS (SELECT p_type, p_brand, p_partkey, median(p_retailprice) AS v FROM part GROUP BY 1, 2, 3),
n AS (SELECT *, count(*) OVER (PARTITION BY p_type, p_brand) AS c FROM k),
o AS (SELECT a.p_type, a.p_brand, a.p_partkey, a.v, b.v AS w FROM n a JOIN n b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.c > 8),
m AS (SELECT p_type, p_brand, p_partkey, v, count(*) AS n, median(w) AS median, max(w) - min(w) AS spread FROM o GROUP BY 1, 2, 3, 4),
j AS (SELECT m.p_type, m.p_brand, m.p_partkey, m.v AS value, m.n, m.median, median(abs(o.w - m.median)) * 1.4826 AS mad, m.spread FROM m JOIN o USING (p_type, p_brand, p_partkey) GROUP BY ALL)"""


@query("""WITH k AS (SELECT p_type, p_brand, p_partkey, median(p_retailprice) AS v FROM part GROUP BY 1, 2, 3),
          s AS (SELECT p_type, p_brand, count(*) AS n, median(v) AS median, min(v) AS low, max(v) AS high, max(v) - min(v) AS spread FROM k GROUP BY 1, 2 HAVING count(*) >= 8)
          SELECT p_type, p_brand, s.n, s.median, median(abs(k.v - s.median)) * 1.4826 AS mad, s.low, s.high, s.spread FROM k JOIN s USING (p_type, p_brand) GROUP BY ALL""")
def peer_stats(spark, sf_dir):
    """A5: statistics over members' medians."""
    return stats.nested_peer_stats(t(spark, sf_dir, "part")[0], ["p_type", "p_brand"], "p_partkey", "p_retailprice")


@query(f"WITH {_PEER_SQL} SELECT * FROM j")
def peers_without_self(spark, sf_dir):
    """Each member against all others of its key."""
    return stats.leave_one_out(t(spark, sf_dir, "part")[0], ["p_type", "p_brand"], "p_partkey", "p_retailprice").drop("low", "high")


@query("""WITH b AS (SELECT l_suppkey, l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2),
          s AS (SELECT l_suppkey, max(hi) - min(lo) AS spread FROM b GROUP BY 1)
          SELECT l_suppkey, l_orderkey, hi - lo AS width, spread FROM b JOIN s USING (l_suppkey) WHERE spread > 0 AND (hi - lo) / spread <= 0.25""")
def narrow_band(spark, sf_dir):
    """bands of a quarter of their peers' spread or less."""
    b = t(spark, sf_dir, "lineitem")[0].groupBy("l_suppkey", "l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count("*").alias("n")).where("n >= 2")
    s = b.groupBy("l_suppkey").agg((F.max("hi") - F.min("lo")).alias("spread"))
    none = F.lit(None).cast("double")
    rows = b.join(s, "l_suppkey").withColumn("width", F.col("hi") - F.col("lo"))
    return rows.where(stats.judge_level(none, none, none, none, F.col("spread"), F.col("width")) == "narrow_band").select("l_suppkey", "l_orderkey", "width", "spread")


@query("""SELECT event_id, count(*) OVER w AS peers, min(value) OVER w AS least, max(value) OVER w AS most FROM events
          WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def asof_peers(spark, sf_dir):
    """What was there before, of the same kind; day by day, with what earlier days carry over."""
    e = t(spark, sf_dir, "events")[0]
    v = F.col("value")
    out = selection.running(e, ["event_type"], [F.asc("ts"), F.asc("event_id")], F.to_date("ts"), {"peers": ("count", F.lit(1)), "least": ("min", v), "most": ("max", v)})
    return out.select("event_id", F.coalesce("peers", F.lit(0)).alias("peers"), "least", "most")


@query("""SELECT event_id, CAST(coalesce(sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS peers_at_time FROM events""")
def peers_at_time(spark, sf_dir):
    """W12, ST3: members of the base that came earlier."""
    e = t(spark, sf_dir, "events")[0].withColumn("pile", F.when(F.col("value") < 50, "base").otherwise("none"))
    return kb.peers_before(e, "event_type", ["ts", "event_id"], F.to_date("ts")).select("event_id", "peers_at_time")


@query("WITH d AS (SELECT p_type, p_brand, count(DISTINCT p_size) AS m FROM part GROUP BY ALL), l AS (SELECT p_type || '/' || p_brand AS label, p_size FROM part), c AS (SELECT label, count(DISTINCT p_size) AS m FROM l GROUP BY 1), s AS (SELECT unnest([2,4,6,8,12,20,30]) AS least) SELECT s.least, count(DISTINCT c.label) AS labels, count(DISTINCT l.p_size) AS covered FROM s JOIN c ON c.m >= s.least JOIN l USING (label) GROUP BY 1")
def coverage_histogram(spark, sf_dir):
    """Labels by number of members, and members they cover."""
    rows = t(spark, sf_dir, "part")[0].select(F.concat_ws("/", "p_type", "p_brand").alias("label"), "p_size")
    return stats.depth_histogram(rows, "label", "p_size")


@query("""WITH p AS (SELECT l_orderkey, l_suppkey, count(*) AS n, count(DISTINCT l_quantity) AS d, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1, 2)
          SELECT l_orderkey, l_suppkey, low, high, high - low AS width, (high + low) / 2 AS middle FROM p WHERE n = 2 AND d = 2""")
def band_collapse(spark, sf_dir):
    """Two different values become one band."""
    return selection.collapse_pairs(t(spark, sf_dir, "lineitem")[0], ["l_orderkey", "l_suppkey"], "l_quantity")


@query("""WITH v AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)
          SELECT p_type, p_brand AS spelling, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rk FROM v) WHERE rk = 1""")
def canonical_spelling(spark, sf_dir):
    """The most frequent spelling of a key."""
    v = t(spark, sf_dir, "part")[0].groupBy("p_type", F.col("p_brand").alias("spelling")).agg(F.count("*").alias("n"))
    return selection.top_k(v, ["p_type"], [F.desc("n"), F.asc("spelling")], 1).drop("rank")


# ---------------------------------------------------------------- text

_LINES = r"""l AS (SELECT doc_id, pos - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents")[0].select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_HEAD = r"length(line) BETWEEN 5 AND 90 AND length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 5 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) >= 0.85 * length(regexp_replace(line, '[^A-Za-z]', '', 'g'))"


def _heading(line: Column) -> Column:
    count = lambda p: F.length(F.regexp_replace(line, p, ""))
    return F.length(line).between(5, 90) & (count("[^A-Za-z]") >= 5) & (count("[^A-Z]") >= 0.85 * count("[^A-Za-z]"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, length(line) AS chars FROM l")
def line_table(spark, sf_dir):
    """Documents as numbered lines."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.length("line").alias("chars"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, last_value(CASE WHEN {_HEAD} THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l")
def section_fill(spark, sf_dir):
    """The last heading at or above each line."""
    line = F.col("line")
    return selection.carried_forward(_lines(spark, sf_dir), ["doc_id"], [F.asc("line_no")], F.when(_heading(line), line), "section").select("doc_id", "line_no", "section")


@query(f"""WITH {_LINES} SELECT doc_id, line_no, coalesce(last_value(CASE WHEN {_HEAD} THEN TRUE WHEN contains(line, 'Licensed') THEN FALSE END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), FALSE)
           OR NOT coalesce(max(CASE WHEN {_HEAD} THEN TRUE WHEN contains(line, 'Licensed') THEN FALSE END) OVER (PARTITION BY doc_id), FALSE) AS in_scope FROM l""")
def scope_mask(spark, sf_dir):
    """Open and closed parts; a document that nothing opens counts as a whole."""
    line = F.col("line")
    state = F.when(_heading(line), True).when(F.contains(line, F.lit("Licensed")), False)
    rows = selection.carried_forward(_lines(spark, sf_dir).withColumn("s", state), ["doc_id"], [F.asc("line_no")], F.col("s"), "upto")
    opened = F.coalesce(F.max("s").over(Window.partitionBy("doc_id")), F.lit(False))
    return rows.select("doc_id", "line_no", (F.coalesce("upto", F.lit(False)) | ~opened).alias("in_scope"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, string_agg(CAST(length(line) AS VARCHAR), '|' ORDER BY line_no) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l")
def comparator_window(spark, sf_dir):
    """Two lines either side."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-2, 2)
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.array_join(F.collect_list(F.length("line").cast("string")).over(w), "|").alias("near"))


@query("SELECT doc_id, sha256(text) AS digest, sha256(lower(source)) AS source_key, length(text) // 4 AS tokens FROM documents")
def text_hash(spark, sf_dir):
    """F32: cache keys and token estimates."""
    return t(spark, sf_dir, "documents")[0].select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.lower("source"), 256).alias("source_key"), F.floor(F.length("text") / 4).alias("tokens"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, sf_dir):
    """The text of a page."""
    return t(spark, sf_dir, "pages")[0].select("page_id", html_text(F.col("html")).alias("text"))


# ---------------------------------------------------------------- knowledge base

@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1")
def register_state(spark, sf_dir):
    """The last event of each reference."""
    return kb.last_event(t(spark, sf_dir, "events")[0], "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


_CASES = """k AS (SELECT user_id, event_id, event_type AS kind, CAST(value >= 20 AS BOOLEAN) AS verified,
             CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS points FROM events),
c AS (SELECT *, sum(CAST(verified AS INT)) OVER (PARTITION BY user_id, kind ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS nth FROM k),
p AS (SELECT user_id, event_id, kind, CASE WHEN verified AND nth <= 2 THEN points ELSE 0 END AS counted FROM c),
s AS (SELECT user_id, CAST(sum(counted) AS BIGINT) AS score FROM p GROUP BY 1),
q AS (SELECT user_id, score, CASE WHEN score >= 10 THEN 'alert' WHEN score >= 5 THEN 'watch' ELSE 'close' END AS route FROM s)"""


def _counted(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    rows = events.select("user_id", "event_id", kind.alias("kind"), (F.col("value") >= 20).alias("verified"), F.when(kind == "purchase", 3).when(kind == "click", 2).otherwise(1).alias("points"))
    nth = F.sum(F.col("verified").cast("int")).over(Window.partitionBy("user_id", "kind").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("user_id", "event_id", "kind", F.when(F.col("verified") & (nth <= 2), F.col("points")).otherwise(0).alias("counted"))


def _cases(events: DataFrame) -> DataFrame:
    s = _counted(events).groupBy("user_id").agg(F.sum("counted").alias("score"))
    return s.withColumn("route", F.when(F.col("score") >= 10, "alert").when(F.col("score") >= 5, "watch").otherwise("close"))


@query("""WITH s AS (SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1)
          SELECT e.event_id, e.user_id FROM events e SEMI JOIN s ON e.user_id = s.user_id AND e.event_type = s.event_type""")
def semi_current_run(spark, sf_dir):
    """Rows of the run that counts."""
    e = t(spark, sf_dir, "events")[0]
    s = kb.last_event(e, "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_type")
    return e.join(s, ["user_id", "event_type"], "left_semi").select("event_id", "user_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_todo(spark, sf_dir):
    """What isn't done yet."""
    d, lab = t(spark, sf_dir, "documents", "labels")
    return d.select("doc_id", "lang").join(lab.select("doc_id"), "doc_id", "left_anti")


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def notice_join(spark, sf_dir):
    """Left join with a default."""
    d, lab = t(spark, sf_dir, "documents", "labels")
    return d.select("doc_id", "lang").join(lab, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), "toxic")


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    """a field of a JSON cell."""
    return t(spark, sf_dir, "events")[0].select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT quality, count_if(toxic = 1 AND n_chars > 1000) AS hits, count_if(toxic <> 1 AND n_chars > 1000) AS false_alarms, count_if(toxic = 1 AND NOT n_chars > 1000) AS misses, count_if(toxic = 1 AND n_chars > 1000) / nullif(count_if(n_chars > 1000), 0) AS precision, count_if(toxic = 1 AND n_chars > 1000) / nullif(count_if(toxic = 1), 0) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def precision_recall(spark, sf_dir):
    """Precision and recall by split."""
    lab, d = t(spark, sf_dir, "labels", "documents")
    return stats.precision_recall(lab.join(d.select("doc_id", "n_chars"), "doc_id"), F.col("toxic") == 1, F.col("n_chars") > 1000, ["quality"])


@query("SELECT source, count_if(lang = 'en') AS en, count_if(lang = 'fr') AS fr, count_if(lang = 'de') AS de, count_if(lang = 'es') AS es, median(n_chars) AS median_chars FROM documents GROUP BY 1")
def verdict_pivot(spark, sf_dir):
    """Counts by verdict in columns, with a median."""
    lang = F.col("lang")
    docs = t(spark, sf_dir, "documents")[0].select("source", "lang", "n_chars")
    counts = docs.groupBy("source").agg(*[F.count_if(lang == x).alias(x) for x in ("en", "fr", "de", "es")])
    medians = stats.interpolated(docs, ["source"], "n_chars", {"median_chars": 0.5})
    return counts.alias("c").join(medians.alias("m"), F.col("c.source").eqNullSafe(F.col("m.source")), "left").select("c.*", "median_chars")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, n_chars DESC, doc_id) AS rk FROM documents) WHERE rk = 1")
def best_document(spark, sf_dir):
    """The best document of a group by rank, first at a tie."""
    rank = F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "en", 1).otherwise(2)
    d = t(spark, sf_dir, "documents")[0].select("source", "doc_id", "n_chars", "lang")
    return selection.latest_per_key(d, ["source"], [rank, F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id", "n_chars")


@query("SELECT s_nationkey, s_suppkey, s_acctbal, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rk FROM supplier) WHERE rk <= 3")
def top_k_per_group(spark, sf_dir):
    """The first three of each group."""
    s = t(spark, sf_dir, "supplier")[0].select("s_nationkey", "s_suppkey", "s_acctbal")
    return selection.top_k(s, ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 3)


@query("""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
          i AS (SELECT unnest(range(0, 5)) AS i) SELECT DISTINCT c_nationkey, c_custkey FROM r, i WHERE n <= 5 OR pos = (i * n) // 5""")
def spread_sample(spark, sf_dir):
    """Five evenly spaced rows of each group."""
    c = t(spark, sf_dir, "customer")[0].select("c_nationkey", "c_custkey")
    return selection.evenly_spaced(c, ["c_nationkey"], [F.asc("c_custkey")], 5)


@query("SELECT doc_id, 'quality' AS split, quality AS verdict FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE toxic = 1")
def union_labels(spark, sf_dir):
    """Two label tables as one."""
    lab = t(spark, sf_dir, "labels")[0]
    one = lab.select("doc_id", F.lit("quality").alias("split"), F.col("quality").alias("verdict"))
    return one.unionByName(lab.where("toxic = 1").select("doc_id", F.lit("toxic").alias("split"), F.col("toxic").alias("verdict")))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def exclude_seen(spark, sf_dir):
    """A difference of sets."""
    o = t(spark, sf_dir, "orders")[0]
    return o.where("o_orderstatus = 'F'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_anti")


@query("SELECT event_id, CAST(sum(value > 50) OVER (PARTITION BY event_type ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events".replace("sum(value > 50)", "sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)"))
def token_window(spark, sf_dir):
    """What fell into the last hour; hour by hour, each with the rows of the hour before."""
    e = t(spark, sf_dir, "events")[0].select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), F.when(F.col("value") > 50, 1).otherwise(0).alias("v"))
    return selection.within(e, ["event_type"], "s", "v", 3_600_000_000, "recent").select("event_id", "recent")


@query("""WITH x AS (SELECT r_name, n_nationkey FROM region JOIN nation ON r_regionkey = n_regionkey)
          SELECT r_name, count(DISTINCT c_custkey) AS buyers, count(DISTINCT s_suppkey) AS suppliers, max(c_acctbal) AS most FROM x LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def families(spark, sf_dir):
    """Groups in scope with their members, started or not."""
    r, n, c, s = t(spark, sf_dir, "region", "nation", "customer", "supplier")
    x = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_nationkey")
    buyers = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("b"), F.max("c_acctbal").alias("m"))
    suppliers = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("s"))
    out = x.join(F.broadcast(buyers), "n_nationkey", "left").join(F.broadcast(suppliers), "n_nationkey", "left")
    return out.groupBy("r_name").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("buyers"), F.coalesce(F.sum("s"), F.lit(0)).alias("suppliers"), F.max("m").alias("most"))
