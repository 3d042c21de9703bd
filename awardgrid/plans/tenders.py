"""Registered queries on made-up tenders: the driver's rows, given the cells that procurement feeds have.

A column is written once, as SQL that both engines read, so every branch of an operator occurs; what the
operator makes of it is written apart, as the rule says it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardgrid.functions import measures, names
from awardgrid.operators import agents, attachments, awards, brands, documents, evaluation, incremental, level2, matching, observations, quotes, scoring, screening, selection, stats
from awardgrid.plans.registry import _ordered, query, t
from awardgrid.sources import feeds
from awardgrid.streaming import knowledge_base as kb


def made(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sql(name: str, columns: dict[str, str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})"


def case(key: str, *values: str, other: str = "''") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {other} END"


# ---------------------------------------------------------------- notices

NOTICES = {
    "reference": "'T' || CAST(o_orderkey AS STRING)",
    "row_seq": "o_orderkey",
    "method": case("o_orderkey % 9", "'Advance Contract Award Notice'", "'Limited tendering'", "' Competitive - Open '", "'non-competitive, selective'", "'Competitive - Open'", "NULL", other="'Selective ' || substr(o_orderpriority, 1, 1)"),
    "notice_type": case("o_orderkey % 11", "'Request for Information'", "'request for supply arrangement '", "'advance contract award notice'", "NULL", other="'Tender'"),
    "reason": case("o_orderkey % 13", "'None'", "' *None '", "'n/a'", "'Sans objet'", "'Sole source of supply'", "NULL", "'not applicable'", other="''"),
    "trade": case("o_orderkey % 5", "'* none'", "'None'", "'CFTA'", "NULL", other="''"),
    "status": case("o_orderkey % 17", "'Cancelled'", "' OPEN'", "'active'", "NULL", other="'Expired'"),
    "published": case("o_orderkey % 23", "NULL", "'unknown'", other="substr(CAST(o_orderdate AS STRING), 1, 10) || ' 10:00'"),
    "closing": "CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 45 - 3 AS INT) AS STRING)",
    "buyer": "'Department ' || CAST(o_custkey % 40 AS STRING) || CASE o_custkey % 3 WHEN 0 THEN ' Inc.' ELSE '' END",
    "solicitation": case("o_orderkey % 4", "'W84-' || CAST(o_orderkey AS STRING) || '/A'", "'w84 -' || CAST(o_orderkey AS STRING)", "''", other="'E60-' || CAST(o_orderkey % 100 AS STRING) || ' VERSION B'"),
    "unspsc": case("o_custkey % 4", "'*25' || CAST(10 + o_custkey % 5 AS STRING) || '1500, *41101500'", "'12\n*4110' || CAST(1000 + o_custkey % 9000 AS STRING)", "''", other="'*2510' || CAST(o_custkey % 90 + 10 AS STRING)"),
    "days_given": "o_custkey % 45 - 3",
}
_N = sql("n", NOTICES, "orders")
_CODE = "coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(unspsc, ''), '[\\r\\n,;|\\s]+'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')), lambda c: length(c) >= 4)[1], '')"


def notices(spark, sf_dir: str) -> DataFrame:
    return made(t(spark, sf_dir, "orders")[0], NOTICES)


_SCREEN = rf"""{_N},
b AS (SELECT *, trim(coalesce(method, '')) AS m, CASE WHEN published IS NOT NULL AND published <> 'unknown' AND days_given >= 0 THEN CAST(days_given AS DOUBLE) END AS days FROM n),
c AS (SELECT m, count(*) AS k, median(days) AS med FROM b WHERE days IS NOT NULL GROUP BY m HAVING count(*) >= 20),
s AS (SELECT c.m, c.k, c.med, 1.4826 * median(abs(b.days - c.med)) AS mad FROM b JOIN c USING (m) WHERE days IS NOT NULL GROUP BY ALL),
g AS (SELECT b.*, s.k, round_even(s.med, 1) AS median, round_even(s.mad, 3) AS mad FROM b LEFT JOIN s USING (m)),
f AS (SELECT *, regexp_matches(m || '~' || coalesce(notice_type, ''), '(?i)advance contract award') AS acan, regexp_matches(m, '(?i)limited tendering|non-competitive') AS limited,
        trim(coalesce(reason, '')) <> '' AND NOT regexp_matches(trim(reason), '(?i)^\s*\*?\s*(none|n/?a|not applicable|sans objet)\s*$') AS told,
        coalesce(mad > 0 AND (days - median) / mad <= -1, FALSE) AS short, days IS NOT NULL AND k IS NULL AS rare, regexp_matches(trim(coalesce(trade, '')), '(?i)^\s*\*?\s*none\s*$') AS free FROM g),
r AS (SELECT *, acan::INT + limited::INT + coalesce(told, FALSE)::INT AS strong, short::INT + free::INT AS weak, row_seq % 3 = 0 AS documents FROM f)"""


@query(rf"""WITH {_SCREEN} SELECT reference, CASE WHEN strong > 0 OR weak >= 2 THEN CASE WHEN documents THEN 'deep' ELSE 'deep_unreadable' END WHEN weak > 0 THEN 'watch' ELSE 'close' END AS route, strong, weak, days, median, mad, documents,
          concat_ws(',', CASE WHEN acan THEN 'acan' END, CASE WHEN limited THEN 'limited_tendering_method' END, CASE WHEN told THEN 'limited_tendering_reason' END, CASE WHEN short THEN 'short_window' END, CASE WHEN rare THEN 'window_not_comparable' END, CASE WHEN free THEN 'no_trade_agreement' END) AS signals FROM r""")
def notice_screen(spark, sf_dir):
    """Every notice with its signals and route, against its method's windows."""
    n = notices(spark, sf_dir)
    out = screening.screen(n, n.where("row_seq % 3 = 0").select("reference"))
    return out.select("reference", "route", "strong", "weak", "days", "median", "mad", "documents", F.array_join(F.transform("signals", lambda s: s["signal"]), ",").alias("signals"))


@query(rf"""WITH {_SCREEN}, q AS (SELECT *, CASE WHEN strong > 0 OR weak >= 2 THEN 0 WHEN weak > 0 THEN 2 ELSE 3 END AS place FROM r WHERE documents AND substr({_CODE}, 1, 4) = '2510')
          SELECT reference, row_number() OVER (ORDER BY place, strong DESC, weak DESC, row_seq) AS position FROM q""")
def screened_category(spark, sf_dir):
    """A category's readable notices in the order of the screen."""
    n = notices(spark, sf_dir)
    out = screening.screen_all(n, n.where("row_seq % 3 = 0").select("reference"), "2510", True)
    return selection.numbered(out, screening.screen_order(out, "row_seq")).select("reference", "position")


@query(rf"""WITH {_N} SELECT reference, CASE WHEN lower(trim(coalesce(status, ''))) = 'cancelled' THEN 'the tender was cancelled' WHEN lower(trim(coalesce(status, ''))) = 'open' THEN 'the tender is still open'
          WHEN row_seq % 11 = 0 THEN 'it is a request for information, which does not lead to a contract' WHEN row_seq % 11 = 1 THEN 'it is a request for supply arrangement, which does not lead to a contract' END AS reason FROM n""")
def no_contract_reason(spark, sf_dir):
    """Why a notice led to no contract."""
    return notices(spark, sf_dir).select("reference", screening.no_contract_reason(F.col("status"), F.col("notice_type")).alias("reason"))


@query(rf"""WITH {_N}, x AS (SELECT *, {_CODE} AS code FROM n) SELECT reference, CASE WHEN code <> '' THEN code END AS code, substr(code, 1, 8) AS unspsc8, substr(trim(coalesce(published, '')), 1, 10) AS pub_date FROM x WHERE row_seq % 5 = 0""")
def notice_codes(spark, sf_dir):
    """The first code of a notice, and what is known of the notices that a table names."""
    n = notices(spark, sf_dir)
    meta = feeds.notice_meta(n, n.where("row_seq % 5 = 0").select("reference"))
    return n.select("reference", names.first_code(F.col("unspsc")).alias("code")).join(meta, "reference")


_CATEGORY = {"p_partkey": "p_partkey", "cell": case("p_partkey % 6", "'*GD\n*SRV'", "'*gd'", "' *CNST ; GD,*GD'", "NULL", "''", other="'*SRVTGD|* SRV'")}


@query(f"""WITH {sql("c", _CATEGORY, "part")} SELECT p_partkey, {case("p_partkey % 6", "['GD','SRV']", "['GD']", "['CNST','GD']", "[]", "[]", other="['SRVTGD','SRV']")} AS found, p_partkey % 6 < 3 AS goods FROM c""")
def category_cells(spark, sf_dir):
    """The set in a cell of starred categories, and whether goods are in it."""
    c = made(t(spark, sf_dir, "part")[0], _CATEGORY).withColumn("found", names.categories(F.col("cell")))
    return c.select("p_partkey", "found", F.arrays_overlap("found", F.array(F.lit("GD"))).alias("goods"))


# ---------------------------------------------------------------- names

_FIRMS = {
    "s_suppkey": "s_suppkey",
    "name": case("s_suppkey % 12", "'Agilent Technologies Canada Inc.'", "'Smith & Sons, Ltd ' || CAST(s_nationkey AS STRING)", "'The Northern Group International GmbH'", "'Bell Horizon J.V. Joint Venture'", "'  ABC-Tools   CO. LLC'", "'12345 Canada Inc'", "'Acme S.R.L. srl'", "NULL", "'Les Forges du Nord Company'", "'Marine LP Systems Ulc'", other="s_name || ' Limited'"),
    "number": case("s_suppkey % 8", "'w8476-123456/A'", "'23-58204 Version B'", "'E60HP 11000x'", "'AB-01'", "''", "'A1_2'", "'SOL123456C'", other="'X' || CAST(s_suppkey AS STRING)"),
    "postal": case("s_suppkey % 4", "'K1A 0B1'", "'h2x-1y' || CAST(s_suppkey % 10 AS STRING)", "''", other="'M5V' || CAST(s_nationkey AS STRING)"),
}
_FIRM_SQL = sql("f", _FIRMS, "supplier")
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(upper(name), '(?i)\b(inc|incorporated|ltd|ltee|ltée|limited|corp|corporation|co|company|llc|lp|ulc|srl|sa|gmbh)\b\.?', ' ', 'g'), '[^A-Z0-9À-Ÿ ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_GENERIC = "['CANADA','CANADIAN','GROUP','THE','LE','LA','LES','DE','DU','DES','ET','AND','OF','LLP','LP','INTERNATIONAL','DIVISION','DIV','HOLDINGS']"
_SQUEEZED = r"regexp_replace(upper(number), '\s+', '', 'g')"
_BASED = f"CASE WHEN regexp_matches({_SQUEEZED}, '(VERSION[A-Z0-9]+|[/_-][A-Z0-9]{{1,3}})$') THEN regexp_replace({_SQUEEZED}, '(VERSION[A-Z0-9]+|[/_-][A-Z0-9]{{1,3}})$', '') ELSE regexp_replace({_SQUEEZED}, '([0-9])[A-Z]$', '\\1') END"


@query(f"""WITH {_FIRM_SQL}, x AS (SELECT *, {_NORMAL} AS normal FROM f), y AS (SELECT *, list_filter(string_split(normal, ' '), lambda w: w <> '' AND NOT list_contains({_GENERIC}, w)) AS ws FROM x)
          SELECT s_suppkey, normal, array_to_string(ws, ' ') AS core, list_filter(ws, lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$'))[1] AS first_word, regexp_matches(normal, '\\b(JOINT VENTURE|J V|JV|S E N C|SENC|COENTREPRISE)\\b') AS venture,
                 regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS squashed FROM y""")
def name_norm(spark, sf_dir):
    """Names without legal forms and signs, their core, first word and respelling key; joint ventures."""
    f = made(t(spark, sf_dir, "supplier")[0], _FIRMS).withColumn("normal", names.normal_name(F.col("name")))
    n = F.col("normal")
    return f.select("s_suppkey", "normal", names.core_name(n).alias("core"), names.first_word(n).alias("first_word"), names.joint_venture(n).alias("venture"), names.squash(F.col("name")).alias("squashed"))


@query(f"""WITH {_FIRM_SQL} SELECT s_suppkey, nullif({_SQUEEZED}, '') AS sol, nullif(CASE WHEN length({_BASED}) >= 6 THEN {_BASED} ELSE {_SQUEEZED} END, '') AS base, nullif(regexp_replace(upper(postal), '[^A-Z0-9]', '', 'g'), '') AS postal FROM f""")
def number_norm(spark, sf_dir):
    """solicitation numbers, without their endings, and postal codes."""
    f = made(t(spark, sf_dir, "supplier")[0], _FIRMS)
    return f.select("s_suppkey", names.solicitation(F.col("number")).alias("sol"), names.base_solicitation(F.col("number")).alias("base"), names.postal_code(F.col("postal")).alias("postal"))


@query(f"""WITH {_FIRM_SQL}, b AS (SELECT DISTINCT {_NORMAL} AS name, nullif(regexp_replace(upper(postal), '[^A-Z0-9]', '', 'g'), '') AS p FROM f WHERE name IS NOT NULL),
          x AS (SELECT name, p, coalesce(list_filter(string_split(name, ' '), lambda w: w <> '' AND NOT list_contains({_GENERIC}, w) AND length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$'))[1], '') AS w FROM b),
          m AS (SELECT a.name, b.name AS variant, min(CASE WHEN a.p = b.p THEN CASE WHEN a.w = b.w THEN 0 ELSE 1 END ELSE 2 END) AS far FROM x a JOIN x b ON a.name <> b.name AND (a.p = b.p OR (a.w <> '' AND a.w = b.w)) GROUP BY 1, 2)
          SELECT name, variant FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY far, variant) AS rk FROM m) WHERE rk <= 12""")
def supplier_variants(spark, sf_dir):
    """The twelve closest names that share a postal code or a first word."""
    f = made(t(spark, sf_dir, "supplier")[0], _FIRMS).select(names.normal_name(F.col("name")).alias("name"), "postal")
    return awards.spelling_variants(f, "name", "postal")


@query("""WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[0-9a-zà-ÿ]+')) AS ws FROM part)
          SELECT a.p_partkey, b.p_partkey AS host FROM w a JOIN w b ON a.p_partkey <> b.p_partkey AND list_has_all(b.ws, a.ws)""")
def name_subset(spark, sf_dir):
    """Names all of whose words another one has; they meet by their rarest word."""
    return awards.hosted_names(t(spark, sf_dir, "part")[0], "p_partkey", "p_name")


_PAIRS = {
    "p_partkey": "p_partkey", "brand": case("p_partkey % 5", "substr(p_name, 1, 6)", "p_name", "'GE Healthcare'", "''", other="p_brand"),
    "company": case("p_partkey % 4", "p_name || ' of Canada'", "'Siemens Healthcare'", "'GE HEALTHCARE (CANADA)'", other="'Supplier of ' || p_brand || ', ' || p_type"),
}
_W = "regexp_extract_all(lower({}), '[0-9a-zà-ÿ]+')"


@query(f"""WITH {sql("c", _PAIRS, "part")}, w AS (SELECT p_partkey, {_W.format('brand')} AS b, {_W.format('company')} AS c FROM c)
          SELECT p_partkey, len(b) > 0 AND list_has_all(c, b) AS part_of, len(b) > 0 AND c[1:len(b)] = b AS begins, len(b) > 0 AND contains(' ' || array_to_string(c, ' ') || ' ', ' ' || array_to_string(b, ' ') || ' ') AS says FROM w""")
def brand_matches(spark, sf_dir):
    """Brands and companies: all words, the first words, or the words in a row."""
    c = made(t(spark, sf_dir, "part")[0], _PAIRS)
    brand, company = F.col("brand"), F.col("company")
    return c.select("p_partkey", names.part_of(brand, company).alias("part_of"), names.begins_with(company, brand).alias("begins"), names.says(company, brand).alias("says"))


# ---------------------------------------------------------------- awards

AWARDS = {
    "reference": "'T' || CAST(l_orderkey AS STRING)",
    "solicitation": case("l_orderkey % 4", "'W84-' || CAST(l_orderkey AS STRING) || '/B'", "'W84-' || CAST(l_orderkey AS STRING)", "''", other="NULL"),
    "supplier": case("l_suppkey % 9", "'Supplier ' || CAST(l_suppkey AS STRING) || ' Inc.'", "'SUPPLIER ' || CAST(l_suppkey % 30 AS STRING) || ' Ltd'", "' '", other="'Supplier ' || CAST(l_suppkey % 30 AS STRING)"),
    "buyer": "'Department ' || CAST(o_custkey % 40 AS STRING)",
    "value": "CAST(l_linenumber AS STRING)", "award_date": "substr(CAST(l_shipdate AS STRING), 1, 10)",
    "unspsc": "CASE WHEN l_partkey % 3 = 0 THEN '' ELSE '2510' || CAST(10 + l_partkey % 3 AS STRING) END",
    "postal": "'K1A ' || CAST(l_suppkey % 7 AS STRING) || 'B' || CAST(l_suppkey % 3 AS STRING)", "city": case("l_linenumber % 3", "'OTTAWA'", "''", other="'hull'"),
    "title": "'Award of ' || CAST(l_partkey % 50 AS STRING)", "row_seq": "l_orderkey * 1000000000 + l_linenumber * 10000000 + l_suppkey * 10000 + l_partkey % 10000",
}
_A = f"""{sql("aw", AWARDS, "lineitem JOIN orders ON l_orderkey = o_orderkey")},
ax AS (SELECT DISTINCT ON (row_seq, supplier, buyer, award_date, unspsc) *, {_NORMAL.replace('upper(name)', 'upper(supplier)')} AS sup, upper(buyer) AS buy, nullif({_SQUEEZED.replace('number', 'solicitation')}, '') AS sol, substr(unspsc, 1, 4) AS grp FROM aw WHERE trim(supplier) <> ''),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(sol, reference), sup ORDER BY row_seq, award_date, unspsc) AS rk FROM ax) WHERE rk = 1)"""


def _fed(spark, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    """Cells of award rows, made after rows of one number in the feed have met: numbers travel, not cells."""
    rows, n = _ordered(spark, sf_dir, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "o_custkey")
    rows = selection.spread(rows.withColumn("row_seq", F.expr(columns["row_seq"])), n, "row_seq")
    return made(rows, columns | {"row_seq": "row_seq"})


def award_feed(spark, sf_dir: str) -> DataFrame:
    rows = _fed(spark, sf_dir, AWARDS)
    return awards.prepared_awards(rows.dropDuplicates(["row_seq", "supplier", "buyer", "award_date", "unspsc"]))


def _once(spark, sf_dir: str) -> DataFrame:
    return awards.dedup_awards(award_feed(spark, sf_dir), F.coalesce("sol", "ref"), "supplier", [F.asc("row_seq"), F.asc("award_date"), F.asc("group")])


@query(f"WITH {_A} SELECT buy AS buyer, grp, count(*) AS awards, count(DISTINCT sup) AS suppliers FROM once GROUP BY 1, 2")
def award_dedup(spark, sf_dir):
    """A2, S3: awards counted once for each contract and supplier, the first row in the feed, by buyer and group."""
    return _once(spark, sf_dir).withColumnRenamed("group", "grp").groupBy("buyer", "grp").agg(F.count("*").alias("awards"), F.count_distinct("supplier").alias("suppliers"))


@query(f"""WITH {_A}, c AS (SELECT sup, city, count(*) AS n FROM (SELECT sup, upper(substr(trim(city), 1, 1)) || lower(substr(trim(city), 2)) AS city FROM ax WHERE trim(city) <> '') GROUP BY 1, 2),
          t AS (SELECT sup, list(city ORDER BY n DESC, city)[1:2] AS cities FROM c GROUP BY 1), p AS (SELECT sup, list_sort(list_distinct(list(regexp_replace(upper(postal), '[^A-Z0-9]', '', 'g')))) AS codes FROM ax GROUP BY 1)
          SELECT o.sup AS supplier, count(*) AS awards, array_to_string(any_value(cities), '|') AS cities, array_to_string(any_value(codes), '|') AS codes FROM once o LEFT JOIN t USING (sup) LEFT JOIN p USING (sup) GROUP BY 1""")
def supplier_places(spark, sf_dir):
    """A3, S3: a supplier's two most frequent cities, its postal codes and awards."""
    out = awards.supplier_places(award_feed(spark, sf_dir))
    return out.select("supplier", "awards", F.array_join("cities", "|").alias("cities"), F.array_join("codes", "|").alias("codes"))


@query(f"""WITH {_A}, s AS (SELECT CASE WHEN CAST(substr(sup, 10) AS INT) % 2 = 1 AND CAST(substr(sup, 10) AS INT) < 30 THEN 'SUPPLIER ' || CAST(CAST(substr(sup, 10) AS INT) - 1 AS VARCHAR) ELSE sup END AS sup, buy, grp FROM once)
          SELECT buy AS buyer, grp, count(*) AS awards, count(DISTINCT sup) AS suppliers FROM s GROUP BY 1, 2""")
def collapsed_suppliers(spark, sf_dir):
    """Distinct suppliers with accepted spellings taken for their winner."""
    alias = spark.range(0, 30, 2).select(F.concat(F.lit("SUPPLIER "), F.col("id").cast("string")).alias("winner"), F.concat(F.lit("SUPPLIER "), (F.col("id") + 1).cast("string")).alias("name"))
    return agents.collapsed_suppliers(_once(spark, sf_dir).withColumnRenamed("group", "grp"), alias, ["buyer", "grp"])


_MATCH = f"""{_A}, {_N},
nn AS (SELECT reference AS ref, nullif({_SQUEEZED.replace('number', 'solicitation')}, '') AS nsol, upper(regexp_replace(buyer, ' Inc\\.$', '')) AS nbuy FROM n),
m1 AS (SELECT nn.ref, ax.*, 'solicitation' AS via FROM nn JOIN ax ON nn.nsol = ax.sol),
m2 AS (SELECT nn.ref, ax.*, 'reference' AS via FROM nn JOIN ax ON nn.ref = ax.reference WHERE nn.ref NOT IN (SELECT ref FROM m1)),
mm AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2)"""


# Notices and awards in which every step of the cascade and every verdict occurs. Buyers with even numbers buy from a firm of
# their own, of the odd ones most from one firm that sells to all of them, and every fifth from anybody.
STEP_NOTICES = {
    "reference": "'N' || CAST(o_orderkey AS STRING)", "solicitation": case("o_orderkey % 4", "'W84AB-' || CAST(o_orderkey AS STRING) || '/001'", "'W84AB-' || CAST(o_orderkey AS STRING)", "NULL", other="'ZZ-' || CAST(o_orderkey AS STRING)"),
    "buyer": "'Dept ' || CAST(o_custkey % 20 AS STRING)", "unspsc": "'25101000'",
}
STEP_AWARDS = {
    "reference": "CASE WHEN l_orderkey % 4 = 2 THEN 'N' || CAST(l_orderkey AS STRING) ELSE '' END",
    "solicitation": case("l_orderkey % 4", "'W84AB-' || CAST(l_orderkey AS STRING) || '/002'", "'w84ab- ' || CAST(l_orderkey AS STRING)", "NULL", other="'YY-' || CAST(l_orderkey AS STRING)"),
    "supplier": "CASE WHEN o_custkey % 5 = 4 OR l_linenumber % 5 = 0 THEN 'Other ' || CAST(l_suppkey AS STRING) WHEN o_custkey % 2 = 0 THEN 'Own ' || CAST(o_custkey % 20 AS STRING) ELSE 'Wide' END",
    "buyer": "CASE WHEN l_orderkey % 8 = 0 THEN 'Elsewhere' ELSE 'Dept ' || CAST(o_custkey % 20 AS STRING) END",
    "value": "'1'", "award_date": "substr(CAST(l_shipdate AS STRING), 1, 10)", "unspsc": "'25101000'", "row_seq": "l_orderkey * 10 + l_linenumber",
}
_STEPS = f"""{sql("n", STEP_NOTICES, "orders")}, aw AS (SELECT DISTINCT * FROM (WITH {sql("x", STEP_AWARDS, "lineitem JOIN orders ON l_orderkey = o_orderkey")} SELECT * FROM x)),
ax AS (SELECT upper(supplier) AS sup, upper(buyer) AS buy, upper(replace(solicitation, ' ', '')) AS sol, reference AS ref, award_date, row_seq FROM aw),
m1 AS (SELECT n.reference, ax.*, 'solicitation' AS via FROM n JOIN ax ON n.solicitation = ax.sol),
m2 AS (SELECT n.reference, ax.*, 'reference' AS via FROM n JOIN ax ON n.reference = ax.ref WHERE n.reference NOT IN (SELECT reference FROM m1)),
m3 AS (SELECT n.reference, ax.*, 'base' AS via FROM n JOIN ax ON regexp_replace(n.solicitation, '/00[0-9]$', '') = regexp_replace(ax.sol, '/00[0-9]$', '') AND upper(n.buyer) = ax.buy
       WHERE n.reference NOT IN (SELECT reference FROM m1 UNION ALL SELECT reference FROM m2)),
mm AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""


def stepped(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = t(spark, sf_dir, "orders")[0]
    feed = _fed(spark, sf_dir, STEP_AWARDS).distinct()
    return made(o, STEP_NOTICES), awards.prepared_awards(feed)


@query(f"WITH {_STEPS} SELECT reference, sup AS supplier, row_seq, award_date, via FROM mm")
def cascade_steps(spark, sf_dir):
    """All three steps: by solicitation number, by reference, by the number without its ending and the buyer."""
    return awards.match_awards(*stepped(spark, sf_dir)).select("reference", "supplier", "row_seq", "award_date", "via")


@query(f"""WITH {_STEPS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY award_date DESC, sup, row_seq) AS rk FROM mm) WHERE rk = 1),
o1 AS (SELECT DISTINCT buy, sup, coalesce(sol, ref) AS contract FROM ax),
c AS (SELECT buy, sup, count(*) AS n FROM o1 GROUP BY 1, 2), b AS (SELECT buy, sum(n) AS total FROM c GROUP BY 1), s AS (SELECT sup, sum(n) AS sold, count(*) AS buyers FROM c GROUP BY 1)
SELECT reference, sup AS supplier_key, via, CAST(total AS BIGINT) AS buyer_awards, n AS to_this_supplier, round_even(n / total, 3) AS share, CAST(sold AS BIGINT) AS supplier_awards, buyers AS supplier_buyers,
       CASE WHEN total >= 3 AND n / total >= 0.5 THEN CASE WHEN n / sold >= 0.5 THEN 'dependent_supplier' ELSE 'recurring_supplier' END END AS kind
FROM f JOIN c USING (buy, sup) JOIN b USING (buy) JOIN s USING (sup)""")
def award_verdicts(spark, sf_dir):
    """How the buyer and the winner of each notice stand: recurring, dependent or neither."""
    found = awards.investigate(*stepped(spark, sf_dir))
    return found.select("reference", "supplier_key", "via", "buyer_awards", "to_this_supplier", "share", "supplier_awards", "supplier_buyers", "kind")


@query(f"WITH {_MATCH} SELECT ref AS reference, sup AS supplier, row_seq, award_date, unspsc[1:4] AS grp, via FROM mm")
def cascade_match(spark, sf_dir):
    """A notice's awards by solicitation number, else by reference (none is left for the number without its ending)."""
    out = awards.match_awards(notices(spark, sf_dir), award_feed(spark, sf_dir))
    return out.select("reference", "supplier", "row_seq", "award_date", F.col("group").alias("grp"), "via")


@query(f"""WITH {_MATCH}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY award_date DESC, sup, trim(supplier), row_seq, unspsc) AS rk FROM mm) WHERE rk = 1),
          g AS (SELECT f.ref, f.sup, f.buy, f.award_date, f.via, CASE WHEN f.grp <> '' THEN f.grp ELSE substr({_CODE.replace('unspsc', 'n.unspsc')}, 1, 4) END AS grp FROM f JOIN n ON n.reference = f.ref),
          c AS (SELECT buy, grp, sup, count(*) AS k FROM once GROUP BY 1, 2, 3), tt AS (SELECT buy, grp, sum(k) AS total, count(*) AS suppliers FROM c GROUP BY 1, 2),
          d AS (SELECT sup, count(*) AS sold, count(DISTINCT buy) AS buyers FROM once GROUP BY 1), e AS (SELECT sup, buy, count(*) AS here FROM once GROUP BY 1, 2)
          SELECT g.ref AS reference, g.sup AS supplier_key, g.grp, g.via, CAST(coalesce(total, 0) AS BIGINT) AS buyer_awards, coalesce(c.k, 0) AS to_this_supplier, coalesce(suppliers, 0) AS distinct_suppliers, sold AS supplier_awards, buyers AS supplier_buyers,
                 CASE WHEN total >= 3 AND coalesce(c.k, 0) / total >= 0.5 THEN CASE WHEN here / sold >= 0.5 THEN 'dependent_supplier' ELSE 'recurring_supplier' END END AS kind
          FROM g LEFT JOIN tt ON tt.buy = g.buy AND tt.grp = g.grp LEFT JOIN c ON c.buy = g.buy AND c.grp = g.grp AND c.sup = g.sup LEFT JOIN d ON d.sup = g.sup LEFT JOIN e ON e.sup = g.sup AND e.buy = g.buy""")
def award_history(spark, sf_dir):
    """Each notice's winner with its share of the buyer's awards and its dependence on the buyer."""
    out = awards.investigate(notices(spark, sf_dir), award_feed(spark, sf_dir))
    return out.select("reference", "supplier_key", F.col("group").alias("grp"), "via", "buyer_awards", "to_this_supplier", "distinct_suppliers", "supplier_awards", "supplier_buyers", "kind")


# ---------------------------------------------------------------- claims and cases

_KINDS = list(scoring.POINTS)
CLAIMS = {
    "reference": "'T' || CAST(l_orderkey AS STRING)", "seq": "l_linenumber * 1000000 + l_suppkey * 1000 + l_partkey % 1000",
    "kind": case("l_partkey % 13", *[f"'{k}'" for k in _KINDS], other="'brand_without_equivalent'"),
    "agent": case("l_partkey % 13", *[f"'{a}'" for a in ("M2", "M4", "M1", "M1", "M1", "M1", "M1", "M2", "M2", "M2", "M3", "M3")], other="'M2'"),
    "file": "CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE 'spec.txt' END", "place": "CASE WHEN l_suppkey % 22 = 0 THEN NULL ELSE 'page 1' END", "line": "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'the words' END", "checked": "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity > 5 END",
}
_POINTS = case("kind", *[], other="0").replace("CASE kind  ELSE", "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.POINTS.items()) + " ELSE")
_SCORED = f"""{sql("cl", CLAIMS, "lineitem")},
cv AS (SELECT *, (coalesce(file, '') <> '' OR coalesce(place, '') <> '') AND coalesce(line, '') <> '' AND coalesce(checked, FALSE) AS verified, kind IN ('narrow_band', 'extreme_threshold', 'within_document_bands') AS two FROM (SELECT DISTINCT ON (reference, seq, kind) * FROM cl ORDER BY reference, seq, kind, file, place, line, checked)),
cg AS (SELECT *, verified AND NOT (kind IN ('recurring_supplier', 'dependent_supplier') AND NOT max(CAST(verified AND agent IN ('M2', 'M4') AND NOT two AS INT)) OVER (PARTITION BY reference) = 1) AS open FROM cv),
cn AS (SELECT *, sum(CAST(open AS INT)) OVER (PARTITION BY reference, CASE WHEN two THEN 'two' WHEN kind = 'brand_without_equivalent' THEN kind ELSE 'x' END ORDER BY seq, kind ROWS UNBOUNDED PRECEDING) AS nth FROM cg),
cs AS (SELECT reference, seq, agent, kind, verified, two, CASE WHEN open AND NOT ((two OR kind = 'brand_without_equivalent') AND nth > 2) THEN {_POINTS} ELSE 0 END AS points,
        CASE WHEN NOT verified THEN 'unverified' WHEN NOT open THEN 'context_only' WHEN (two OR kind = 'brand_without_equivalent') AND nth > 2 THEN 'over_cap' END AS why_zero FROM cn),
cr AS (SELECT reference, CAST(sum(points) AS BIGINT) AS score, CAST(sum(CASE WHEN agent IN ('M2', 'M4') AND NOT two THEN points ELSE 0 END) AS BIGINT) AS doc_score, bool_or(verified AND kind IN ('brand_without_equivalent', 'brand_matches_winner')) AS brand,
        bool_or(points > 0 AND NOT two AND kind NOT IN ('acan', 'limited_tendering_method', 'limited_tendering_reason', 'no_trade_agreement')) AS other FROM cs GROUP BY 1),
q AS (SELECT *, CASE WHEN doc_score >= 5 AND brand THEN 'alert' WHEN score >= 2 AND other THEN 'watch' ELSE 'close' END AS route FROM cr)"""


def scored(spark, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")[0]
    c = selection.spread(li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity").withColumn("reference", F.expr(CLAIMS["reference"])), li.count(), "reference")
    c = made(c, CLAIMS | {"reference": "reference"})
    first = Window.partitionBy("reference", "seq", "kind").orderBy(*[F.asc_nulls_last(x) for x in ("file", "place", "line", "checked")])
    once = c.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    once = once.withColumn("verified", scoring.verified(F.struct(F.col("file").alias("file"), F.col("place").alias("where"), F.col("line").alias("line"), F.col("checked").alias("checked"))))
    return scoring.score_claims(once.withColumn("order", F.struct("seq", "kind")), ["reference"], "order")


def routed(spark, sf_dir: str) -> DataFrame:
    return scoring.decide_routes(scored(spark, sf_dir), ["reference"])


@query(f"WITH {_SCORED} SELECT reference, seq, kind, agent, verified, points, why_zero FROM cs")
def scored_claims(spark, sf_dir):
    """Points of claims, those without checked words, without ground and over their cap zeroed."""
    return scored(spark, sf_dir).select("reference", "seq", "kind", "agent", "verified", "points", "why_zero")


@query(f"""WITH {_SCORED}, d AS (SELECT *, CAST(substr(reference, 2) AS BIGINT) AS k FROM q) SELECT reference, score, doc_score, route, CASE WHEN route IN ('alert', 'watch') THEN 'quarantine' WHEN k % 3 = 0 THEN 'base' ELSE 'none' END AS pile,
          CASE WHEN k % 3 <> 0 THEN 'no_documents' WHEN k % 5 = 0 THEN 'still_open' ELSE route END AS status FROM d""")
def pile_routing(spark, sf_dir):
    """route, pile and status of each case."""
    k = F.substring("reference", 2, 20).cast("long")
    docs = k % 3 == 0
    return routed(spark, sf_dir).select("reference", "score", "doc_score", "route", scoring.pile(F.col("route"), docs).alias("pile"), scoring.status(F.col("route"), docs, k % 5 == 0).alias("status"))


@query(f"WITH {_SCORED} SELECT reference, score, route, row_number() OVER (ORDER BY CASE route WHEN 'alert' THEN 0 WHEN 'watch' THEN 1 ELSE 2 END, score DESC, reference) AS position FROM q")
def rank_queue(spark, sf_dir):
    """The review queue."""
    return scoring.rank_queue(routed(spark, sf_dir).select("reference", "score", "route"), "reference")


@query(f"WITH {_SCORED}, x AS (SELECT reference, CASE WHEN score % 4 = 3 THEN NULL ELSE route END AS route, score FROM q) SELECT reference, row_number() OVER (ORDER BY coalesce(CASE route WHEN 'alert' THEN 0 WHEN 'watch' THEN 1 WHEN 'close' THEN 2 END, 3), score DESC, reference) AS position FROM x")
def ranking_with_open(spark, sf_dir):
    """The ranking with references that have no case last."""
    rows = routed(spark, sf_dir).select("reference", "score", F.when(F.col("score") % 4 != 3, F.col("route")).alias("route"))
    return scoring.rank_queue(rows, "reference").select("reference", "position")


@query(f"WITH {_SCORED} SELECT reference, score, row_number() OVER (ORDER BY score DESC, reference) AS against, row_number() OVER (ORDER BY score DESC, reference DESC) AS favour FROM q QUALIFY row_number() OVER (ORDER BY score DESC, reference) <= 50")
def top_with_ties(spark, sf_dir):
    """The first fifty, ties broken for and against."""
    rows = selection.numbered(routed(spark, sf_dir).select("reference", "score"), [F.desc("score"), F.asc("reference")], "against")
    both = selection.numbered(rows, [F.desc("score"), F.desc("reference")], "favour")
    return both.where("against <= 50")


@query(f"""WITH {_SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY points DESC, seq, kind) AS rk FROM cs WHERE verified AND points > 0)
          SELECT q.reference, string_agg(o.kind, ',' ORDER BY rk) AS reasons FROM q LEFT JOIN o ON o.reference = q.reference AND rk <= 2 GROUP BY 1""")
def strongest_claims(spark, sf_dir):
    """The two verified claims with most points of each case."""
    nth = F.row_number().over(Window.partitionBy("reference").orderBy("seq", "kind"))
    per = scored(spark, sf_dir).withColumn("seq", nth).groupBy("reference").agg(F.collect_list(F.struct("points", "kind", "verified", "seq")).alias("claims"))
    reasons = F.transform(scoring.strongest(F.col("claims")), lambda c: c["kind"])
    return per.select("reference", F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).alias("reasons"))


@query(f"WITH {_SCORED} SELECT route, count(*) AS cases, max(score) AS most, min(score) AS least, CAST(sum(score) AS BIGINT) AS points FROM q GROUP BY 1")
def route_summary(spark, sf_dir):
    """Cases by route."""
    return routed(spark, sf_dir).groupBy("route").agg(F.count("*").alias("cases"), F.max("score").alias("most"), F.min("score").alias("least"), F.sum("score").alias("points"))


def tender_documents(spark, sf_dir: str) -> DataFrame:
    """The driver's texts as documents of tenders: requirements in a section, brands in all shapes."""
    d = t(spark, sf_dir, "documents")[0]
    k = F.col("doc_id")
    brand = F.element_at(F.array(*[F.lit(x) for x in ("Palfinger PK11001", "Leica TS16 or equivalent", "Honda GX390", "Bearing Buddy® wheel guards", "Michelin 275/80R22.5", "Windows 10A")]), (k % 6 + 1).cast("int"))
    own = F.when(k % 7 == 0, "The trailer is for transporting a Fat Truck® 2.8C.\n").otherwise("")
    clause = F.when(k % 11 == 0, "Products that are equivalent in form, fit, function and quality will be considered.\n").otherwise("")
    asked = F.when(k % 5 == 0, "\nQuestion 1: would a Kubota M7060 do?\nAnswer: see the requirement.\n").otherwise("\n")
    text = F.concat(F.lit("ANNEX A\nSTATEMENT OF REQUIREMENT\nThe crane must be a "), brand, F.lit(".\n"), own, clause, asked, F.coalesce("text", F.lit("")), F.lit("\nANNEX B - BASIS OF PAYMENT\nInvoice Xerox 9000B\n"))
    return d.select(F.concat(F.lit("T"), (k % 1000).cast("string")).alias("reference"), F.concat(F.when(k % 13 == 0, "amendment ").otherwise("doc "), k.cast("string")).alias("document"), text.alias("text"))


def _verdicts(spark) -> DataFrame:
    known = [("palfinger", True), ("leica", True), ("honda", True), ("michelin", True), ("fat truck", None), ("windows", True), ("kubota", True), ("bearing buddy", True)]
    return spark.createDataFrame(known, "key string, brand boolean")


@query(None)
def brand_level_one(spark, sf_dir):
    """Every name of every tender with its result; tested on fixtures."""
    out = brands.level_one(tender_documents(spark, sf_dir), _verdicts(spark))
    return out.select("reference", "name", "result", "status", "decided_by", "occurrences", "document", "line_no")


@query(None)
def tender_cases(spark, sf_dir):
    """Screen, names, source check, awards and cases as one plan; tested on golden tenders."""
    from awardgrid.plans.chain import tender_chain

    n = notices(spark, sf_dir)
    docs = tender_documents(spark, sf_dir)
    return tender_chain(n, docs, _verdicts(spark), award_feed(spark, sf_dir)).select("reference", "route", "score", "no_contract", F.size("claims").alias("claims"), "narrative")


@query(None)
def question_lines(spark, sf_dir):
    """Which lines a bidder speaks; tested against a plain walk."""
    return documents.question_mask(tender_documents(spark, sf_dir), ["reference", "document"]).where("asked")


@query(None)
def document_measures(spark, sf_dir):
    """What kind of text each document is; tested against plain Python."""
    d = t(spark, sf_dir, "documents")[0].select(F.col("doc_id"), "text")
    m = brands.measure_documents(d, ["doc_id"])
    return m.withColumn("verdict", brands.document_verdict(F.lit(None).cast("int"), F.col("chars"), F.col("req_lines"), F.col("constrained_lines"), F.col("spec_sections")))


@query(None)
def requirement_rows(spark, sf_dir):
    """The observations of all documents, read, banded, converted and folded; tested on fixtures."""
    d = t(spark, sf_dir, "documents")[0]
    weight = F.concat(F.lit("\nSTATEMENT OF REQUIREMENT\nGross vehicle weight shall be at least "), (F.col("doc_id") % 50 + 1).cast("string"), F.lit(",000 kg\n"))
    docs = d.select(F.col("doc_id").cast("string").alias("reference"), F.lit("a").alias("document"), F.concat(F.coalesce("text", F.lit("")), weight).alias("text"))
    meta = d.select(F.col("doc_id").cast("string").alias("reference"), F.lit("25101500").alias("unspsc8"), F.lit("2026-01-01").alias("pub_date"))
    return observations.extract_observations(docs, meta, "r1", "2510").select("reference", "document", "line_no", "label", "comparator", "value", "unit_resolved", "base_value", "restated", "scope")


# ---------------------------------------------------------------- lines of requirements

_TEMPLATES = [  # line, comparator, label, value, unit, base value, base unit, dimension
    ("'The lifting capacity shall be at least ' || v || ' kg'", "GE", "lifting capacity", "v", "kg", "CAST(v AS DOUBLE)", "kg", "mass"),
    ("'Cargo length: maximum ' || v || ' cm'", "LE", "cargo length", "v", "cm", "CAST(v AS DOUBLE) * 10", "mm", "length"),
    ("'Tank volume between ' || v || ' L and ' || v || ' L'", "RANGE", "tank volume", "v", "L", "CAST(v AS DOUBLE)", "L", "volume"),
    ("'Boom reach = ' || v || ' ft'", "EQ", "boom reach", "v", "ft", "CAST(v AS DOUBLE) * 304.8", "mm", "length"),
    ("'Engine power ' || v || ' kW'", "NONE", "engine power", "v", "kW", "CAST(v AS DOUBLE) * 1000", "W", "power"),
    ("'Tire pressure no more than ' || v || ',500 kPa'", "LE", "tire pressure", "v || '500'", "kPa", "CAST(v || '500' AS DOUBLE)", "kPa", "pressure"),
    ("'Operating temperature minimum ' || v || ' °F'", "GE", "operating temperature", "v", "°F", "round_even((CAST(v AS DOUBLE) - 32) * 5 / 9, 6)", "degC", "temperature"),
]
LINES = {"p_partkey": "p_partkey", "v": "CAST(p_size + 10 AS STRING)", "kind": "p_partkey % 7"}
_of = lambda i: "CASE kind " + " ".join(f"WHEN {k} THEN {(x[i] if i in (0, 3, 5) else chr(39) + x[i] + chr(39))}" for k, x in enumerate(_TEMPLATES)) + " END"


@query(f"WITH {sql('l', LINES, 'part')} SELECT p_partkey, {_of(1)} AS comparator, {_of(2)} AS label, {_of(3)} AS value, {_of(4)} AS unit, {_of(7)} AS dimension, {_of(5)} AS base_value, {_of(6)} AS base_unit FROM l")
def line_reading(spark, sf_dir):
    """comparator, label, number, unit and converted value of requirement lines."""
    rows = made(t(spark, sf_dir, "part")[0], LINES).selectExpr("p_partkey", f"{_of(0)} AS line")
    line = F.col("line")
    found = rows.withColumn("x", F.get(measures.values_in(line), F.lit(0)))
    value, unit = measures.parse_number(F.col("x.value_text")), measures.resolved_unit(F.col("x.unit"), F.col("x.tail"))
    return found.select(
        "p_partkey", measures.comparator(line).alias("comparator"), measures.label(line).alias("label"), value.alias("value"), unit.alias("unit"), measures.dimension(unit).alias("dimension"),
        measures.to_base(value, unit).alias("base_value"), measures.base_unit(unit).alias("base_unit"),
    )


_NUMBERS = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "q": "CAST(CAST(l_quantity AS INT) AS STRING)", "kind": "l_partkey % 6"}
_RAW = case("kind", "q || ',600'", "q || ' 300'", "q || ',5'", "q || '.25'", "q", other="'x' || q")


@query(f"WITH {sql('l', _NUMBERS, 'lineitem')} SELECT l_orderkey, l_linenumber, {_RAW} AS raw, {case('kind', chr(39)*2 + ' || q || ' + chr(39) + '600' + chr(39), 'q || ' + chr(39) + '300' + chr(39), 'q || ' + chr(39) + '.5' + chr(39), 'q || ' + chr(39) + '.25' + chr(39), 'q', other='NULL')} AS value FROM l")
def number_extract(spark, sf_dir):
    """grouped thousands, decimal commas and points as canonical numbers."""
    rows = made(t(spark, sf_dir, "lineitem")[0], _NUMBERS).selectExpr("l_orderkey", "l_linenumber", f"{_RAW} AS raw")
    return rows.select("l_orderkey", "l_linenumber", "raw", measures.parse_number(F.col("raw")).alias("value"))


_TAILS = {"p_partkey": "p_partkey", "tail": case("p_partkey % 7", "') deep'", "' x 20'", "' the crate'", "'. - lbs of'", "''", "', or'", other="' total'")}


@query(f"WITH {sql('l', _TAILS, 'part')} SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1, 4, 5) THEN 'inch' END AS unit FROM l")
def inch_resolution(spark, sf_dir):
    """whether a bare "in" is a unit, by what follows."""
    rows = made(t(spark, sf_dir, "part")[0], _TAILS)
    return rows.select("p_partkey", measures.resolved_unit(F.lit("in"), F.col("tail")).alias("unit"))


_HEADS = {"p_partkey": "p_partkey", "line": case("p_partkey % 9", "'STATEMENT OF REQUIREMENT'", "'10.  Evaluation Procedures'", "'ANNEX A ........ 12'", "'DLP 8-2-7 GENERAL'", "'A plain line of text'", "'ABCD'", "' PURCHASE DESCRIPTION '", "'THE NAME OF THE Thing IS LONG'", other="p_name")}


@query(f"WITH {sql('l', _HEADS, 'part')} SELECT p_partkey, p_partkey % 9 IN (0, 1, 6) AS heading FROM l")
def heading_lines(spark, sf_dir):
    """F8: which lines are headings: capitals or numbered, no contents and no running heads."""
    return made(t(spark, sf_dir, "part")[0], _HEADS).select("p_partkey", measures.is_heading(F.col("line")).alias("heading"))


# ---------------------------------------------------------------- observations

OBS = {
    "reference": "'T' || CAST(l_orderkey AS STRING)", "file": "'f' || CAST(l_linenumber % 2 AS STRING)", "line_no": "l_linenumber", "row_seq": "l_linenumber * 1000 + l_suppkey",
    "unspsc8": "'2510' || CAST(1000 + l_suppkey % 3 AS STRING)", "label": case("l_suppkey % 4", "'gross weight'", "'net weight'", "'boilerplate'", other="'length ' || CAST(l_suppkey % 5 AS STRING)"), "raw_label": "CASE WHEN l_partkey % 3 = 0 THEN 'Weight' ELSE 'WEIGHT ' || CAST(l_partkey % 4 AS STRING) END",
    "dimension": "CASE WHEN l_suppkey % 4 < 2 THEN 'mass' ELSE 'length' END", "unit": "CASE WHEN l_suppkey % 4 < 2 THEN 'kg' ELSE 'mm' END", "base_unit": "CASE WHEN l_suppkey % 4 < 2 THEN 'kg' ELSE 'mm' END",
    "comparator": case("l_partkey % 5", "'GE'", "'LE'", "'RANGE'", "'EQ'", other="'NONE'"), "comp_src": case("l_partkey % 3", "'inline'", "'window'", other="'none'"), "label_src": "CASE WHEN l_partkey % 4 = 0 THEN 'above' ELSE 'inline' END",
    "scope": case("l_partkey % 7", "'whole'", "'whole_empty'", other="'section'"), "soft_unit": "l_partkey % 6 = 0", "part_number_line": "l_partkey % 10 = 0",
    "value": "CAST(CAST(l_quantity AS INT) AS STRING)", "value_text": "CAST(CAST(l_quantity AS INT) AS STRING)", "base_value": "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END",
    "base_lo": "CASE WHEN l_partkey % 5 = 2 THEN l_quantity - 1 END", "base_hi": "CASE WHEN l_partkey % 5 = 2 THEN l_quantity + 1 END", "value_hi": "CASE WHEN l_partkey % 5 = 2 THEN l_quantity + 1 END",
    "source_line": "'line ' || CAST(l_linenumber % 3 AS STRING) || ' of ' || CAST(l_orderkey AS STRING)", "pub_date": "substr(CAST(l_shipdate AS STRING), 1, 10)", "section": "'S'", "context": "'c'",
}
_O = sql("ob", OBS, "lineitem")


def observed(spark, sf_dir: str) -> DataFrame:
    return made(t(spark, sf_dir, "lineitem")[0], OBS)


@query(f"""WITH {_O}, d AS (SELECT reference, substr(unspsc8, 1, 8) AS family, label, coalesce(CAST(base_value AS VARCHAR), value) AS v, coalesce(base_unit, unit) AS u, coalesce(CAST(base_hi AS VARCHAR), '') AS hi, count(*) AS restated FROM ob GROUP BY ALL)
          SELECT reference, family, label, restated, count(*) AS requirements FROM d GROUP BY ALL""")
def dedup_restated(spark, sf_dir):
    """Each requirement of a tender once, with how often it was stated."""
    out = observations.dedup_observations(observed(spark, sf_dir), "reference", F.substring("unspsc8", 1, 8), [F.asc("file"), F.asc("line_no"), F.asc("row_seq")])
    return out.withColumn("family", F.substring("unspsc8", 1, 8)).groupBy("reference", "family", "label", "restated").agg(F.count("*").alias("requirements"))


_MAPPED = "CASE label WHEN 'boilerplate' THEN 'unknown' WHEN 'net weight' THEN 'weight' WHEN 'gross weight' THEN 'weight' END"


@query(f"""WITH {_O}, m AS (SELECT * REPLACE (coalesce({_MAPPED}, label) AS label) FROM ob WHERE coalesce({_MAPPED}, '') <> 'unknown'),
          d AS (SELECT *, substr(unspsc8, 1, 8) AS family, row_number() OVER (PARTITION BY reference, substr(unspsc8, 1, 8), label, coalesce(CAST(base_value AS VARCHAR), value), coalesce(base_unit, unit), coalesce(CAST(base_hi AS VARCHAR), '') ORDER BY file, line_no, row_seq, base_value) AS rk FROM m)
          SELECT family, dimension, label, count(DISTINCT reference) AS tenders, count(*) AS requirements FROM d WHERE rk = 1 AND base_value IS NOT NULL GROUP BY ALL""")
def base_requirements(spark, sf_dir):
    """Raw observations as comparable ones: labels mapped, unknown ones dropped, each once, converted ones only."""
    mapping = spark.createDataFrame([("boilerplate", "unknown"), ("net weight", "weight"), ("gross weight", "weight")], "label string, canonical string")
    rows = kb.base_rows(observed(spark, sf_dir), mapping)
    return rows.groupBy("family", "dimension", "label").agg(F.count_distinct("reference").alias("tenders"), F.count("*").alias("requirements"))


BOUNDS = {
    "reference": "CAST(l_orderkey AS STRING)", "line_no": "l_suppkey % 2", "row_seq": "l_linenumber", "label": "'weight'", "unit": "'kg'", "comparator": case("l_linenumber % 5", "'GE'", other="'RANGE'"),
    "value": case("l_partkey % 7", "'0.1'", "'0.2'", "'10000000'", "'30000000'", "'n/a'", "'0.00001'", other="CAST(l_partkey % 97 AS STRING)"),
}


@query(f"""WITH {sql("b", BOUNDS, "lineitem")},
          g AS (SELECT *, try_cast(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY reference, line_no ORDER BY row_seq) AS nth FROM b WHERE comparator = 'RANGE'),
          p AS (SELECT reference, line_no, min(v) AS lo, max(v) AS hi FROM g GROUP BY 1, 2 HAVING count(v) = 2 AND min(v) < max(v))
          SELECT reference, line_no, row_seq, comparator, value, CAST(NULL AS DOUBLE) AS value_lo, CAST(NULL AS DOUBLE) AS value_hi, CAST(NULL AS DOUBLE) AS band_width FROM b WHERE comparator <> 'RANGE'
          UNION ALL SELECT g.reference, g.line_no, row_seq, comparator, CASE WHEN lo IS NULL THEN value ELSE CAST(round((lo + hi) / 2, 6) AS VARCHAR) END, lo, hi, round(hi - lo, 6)
          FROM g LEFT JOIN p USING (reference, line_no) WHERE lo IS NULL OR nth = 1""")
def collapsed_bands(spark, sf_dir):
    """Both bounds of a line become one band, the first row's; other rows stay as they are."""
    rows = made(t(spark, sf_dir, "lineitem")[0], BOUNDS)
    return observations.collapse_bands(rows, ["reference"]).select("reference", "line_no", "row_seq", "comparator", "value", "value_lo", "value_hi", "band_width")


@query(f"""WITH {_O}, r AS (SELECT dimension, label, raw_label, count(*) AS n, row_number() OVER (PARTITION BY dimension, label ORDER BY count(*) DESC, raw_label) AS rk FROM ob GROUP BY 1, 2, 3),
          s AS (SELECT dimension, label, string_agg(raw_label, '|' ORDER BY rk) AS spellings FROM r WHERE rk <= 4 GROUP BY 1, 2)
          SELECT dimension, label, count(DISTINCT reference) AS tenders, count(*) AS observations, count_if(comparator = 'GE') AS ge, count_if(comparator = 'LE') AS le, count_if(comparator = 'RANGE') AS range, count_if(comparator = 'EQ') AS eq, count_if(comparator = 'NONE') AS none,
                 count_if(label_src = 'above') AS above, count(base_value) AS converted, median(base_value) AS median_value, min(pub_date) AS first_date, max(pub_date) AS last_date, any_value(spellings) AS spellings FROM ob JOIN s USING (dimension, label) GROUP BY 1, 2""")
def label_table(spark, sf_dir):
    """A row for each label: tenders, comparators, converted values, dates, spellings."""
    out = observations.label_statistics(observed(spark, sf_dir), [], "reference")
    return out.withColumn("spellings", F.array_join("spellings", "|"))


@query(f"""WITH {_O} SELECT count(*) AS observations, count_if(comp_src = 'inline') / count(*) AS comparator_inline, count_if(comp_src = 'window') / count(*) AS comparator_window, count_if(comp_src = 'none') / count(*) AS comparator_none, count_if(label_src = 'inline') / count(*) AS label_inline, count_if(label_src = 'above') / count(*) AS label_above,
          count_if(scope = 'section') / count(*) AS scope_section, count_if(scope = 'whole') / count(*) AS scope_whole, count_if(scope = 'whole_empty') / count(*) AS scope_whole_empty, count_if(soft_unit) / count(*) AS soft_unit, count_if(part_number_line) / count(*) AS part_number, count_if(dimension IS NULL) / count(*) AS no_dimension FROM ob""")
def hygiene_shares(spark, sf_dir):
    """How observations came about."""
    return observations.hygiene(observed(spark, sf_dir))


@query(f"""WITH {_O}, p AS (SELECT reference AS r, label AS a, list_distinct(list(value)) AS v, list_distinct(list(substr(source_line, 1, 60))) AS s FROM ob GROUP BY 1, 2),
          q AS (SELECT x.a, y.a AS b, list_has_any(x.v, y.v) AS same FROM p x JOIN p y ON x.r = y.r AND x.a < y.a AND NOT list_has_any(x.s, y.s))
          SELECT a, b, count_if(NOT same) AS diff, count_if(same) AS same, count_if(NOT same) > count_if(same) AS veto FROM q GROUP BY 1, 2""")
def cooccurrence_veto(spark, sf_dir):
    """Label pairs of one tender, not from one line; more differing than equal votes veto a merge."""
    return matching.merge_veto(observed(spark, sf_dir), "reference", "label", "value", "source_line")


@query(f"""WITH {_O}, b AS (SELECT dimension, label, reference FROM ob), a AS (SELECT dimension, coalesce({_MAPPED}, label) AS label, reference FROM ob WHERE coalesce({_MAPPED}, '') <> 'unknown'),
          k AS (SELECT 'before' AS stage, dimension, label, count(DISTINCT reference) AS n FROM b GROUP BY 2, 3 UNION ALL SELECT 'after', dimension, label, count(DISTINCT reference) FROM a GROUP BY 2, 3),
          x AS (SELECT 'before' AS stage, * FROM b UNION ALL SELECT 'after', * FROM a)
          SELECT k.stage, count(DISTINCT (k.dimension, k.label)) AS labels, count(DISTINCT reference) AS covered FROM k JOIN x USING (stage, dimension, label) WHERE n >= 8 GROUP BY 1""")
def merge_effect(spark, sf_dir):
    """Labels that enough tenders have, and the tenders they cover, before and after the map."""
    mapping = spark.createDataFrame([("boilerplate", "unknown"), ("net weight", "weight"), ("gross weight", "weight")], "label string, canonical string")
    rows = observed(spark, sf_dir).select(F.lit("f").alias("family"), "dimension", "label", "reference")
    return agents.merge_effect(rows, mapping).withColumnRenamed("when", "stage")


# ---------------------------------------------------------------- peers

PEERS = {
    "reference": "'T' || CAST(p_partkey AS STRING)", "unspsc8": "p_brand || p_type", "dimension": "'mass'", "label": "'weight'", "seq": "p_partkey", "base_value": "CASE WHEN p_partkey % 37 = 0 THEN 5000 ELSE CAST(floor(p_retailprice) AS INT) % 400 END",
    "base_lo": "CASE WHEN p_partkey % 6 = 0 THEN 10 END", "base_hi": "CASE WHEN p_partkey % 6 = 0 THEN 10 + p_size END", "comparator": case("p_partkey % 4", "'LE'", "'EQ'", other="'GE'"),
    "unit": "'kg'", "base_unit": "'kg'", "value": "CAST(p_size AS STRING)", "value_text": "CAST(p_size AS STRING)", "file": "'a'", "section": "'S'", "source_line": "p_name", "context": "''",
}
_JUDGED = f"""{sql("pp", PEERS, "part")},
k AS (SELECT substr(unspsc8, 1, 8) AS family, reference, CAST(base_value AS DOUBLE) AS v, CAST(base_hi AS DOUBLE) - base_lo AS width, comparator FROM pp),
mc AS (SELECT family, count(*) AS c FROM k GROUP BY 1),
pr AS (SELECT a.family, a.reference, b.v AS w FROM k a JOIN k b ON a.family = b.family AND a.reference <> b.reference JOIN mc ON mc.family = a.family WHERE c > 8),
ps AS (SELECT family, reference, count(*) AS n, median(w) AS med, max(w) - min(w) AS spread FROM pr GROUP BY 1, 2),
pm AS (SELECT pr.family, pr.reference, median(abs(w - med)) * 1.4826 AS mad FROM pr JOIN ps USING (family, reference) GROUP BY 1, 2),
j AS (SELECT k.*, n, c, med, spread, mad, CASE WHEN mad > 0 AND mad >= 0.05 * abs(med) THEN (v - med) / mad END AS z, CASE comparator WHEN 'GE' THEN 1 WHEN 'LE' THEN -1 END AS d FROM k JOIN mc USING (family) LEFT JOIN ps USING (family, reference) LEFT JOIN pm USING (family, reference)),
jj AS (SELECT *, CASE WHEN n IS NULL THEN 'insufficient_peers' WHEN width IS NOT NULL AND spread > 0 THEN CASE WHEN width / spread <= 0.25 THEN 'narrow_band' ELSE 'band_not_narrow' END WHEN z IS NULL THEN 'no_peer_spread' WHEN d IS NULL THEN 'no_direction' ELSE 'extreme_threshold' END AS kind FROM j),
jt AS (SELECT *, kind = 'narrow_band' OR (kind = 'extreme_threshold' AND z * d >= 3) AS tight FROM jj)"""


def peered(spark, sf_dir: str) -> DataFrame:
    rows = made(t(spark, sf_dir, "part")[0], PEERS)
    return level2.prepare(rows)


@query(f"WITH {_JUDGED} SELECT reference, family, kind, tight, coalesce(n, c - 1) AS peer_n, med AS peer_median, mad AS peer_mad, CASE WHEN kind IN ('narrow_band', 'band_not_narrow') THEN round_even(width / spread, 3) END AS ratio FROM jt")
def peer_judgements(spark, sf_dir):
    """Every requirement against those of all other tenders."""
    return level2.judged(peered(spark, sf_dir)).select("reference", "family", "kind", "tight", "peer_n", "peer_median", "peer_mad", "ratio")


@query(f"""WITH {_JUDGED}, s AS (SELECT reference, count_if(tight) AS score, count_if(kind = 'insufficient_peers') AS thin FROM jt GROUP BY 1), w AS (SELECT reference, count(*) AS requirements, count_if(width IS NOT NULL) AS two_sided, round_even(count_if(width IS NOT NULL) / count(*), 3) AS share FROM k GROUP BY 1)
          SELECT reference, score, thin, CASE WHEN score >= 2 THEN 'conjunction' WHEN score > 0 THEN 'single' ELSE 'none' END AS verdict, requirements, two_sided, share FROM s JOIN w USING (reference)""")
def tender_scores(spark, sf_dir):
    """Tight requirements and the share of two-sided ones for every tender."""
    rows = peered(spark, sf_dir)
    return level2.tender_scores(rows, level2.judged(rows)).select("reference", "score", "thin", "verdict", "requirements", "two_sided", "share")


@query(f"""WITH {_JUDGED}, s AS (SELECT reference, count_if(tight) AS score FROM jt GROUP BY 1), w AS (SELECT reference, round_even(count_if(width IS NOT NULL) / count(*), 3) AS share FROM k GROUP BY 1)
          SELECT reference, score, share FROM s JOIN w USING (reference) ORDER BY score DESC, share DESC, reference LIMIT 50""")
def rank_tenders(spark, sf_dir):
    """The fifty strictest tenders."""
    rows = peered(spark, sf_dir)
    return level2.rank_tenders(level2.tender_scores(rows, level2.judged(rows))).select("reference", "score", "share")


@query(f"WITH {_JUDGED} SELECT reference, v AS value, med AS median, mad, z FROM jt WHERE width IS NULL AND comparator = 'GE' AND z >= 3")
def extreme_threshold(spark, sf_dir):
    """lower bounds three deviations above their peers'."""
    rows = level2.judged(peered(spark, sf_dir)).where("tight and kind = 'extreme_threshold' and restrictive_z = z")
    return rows.select("reference", "value", F.col("peer_median").alias("median"), F.col("peer_mad").alias("mad"), ((F.col("value") - F.col("peer_median")) / F.col("peer_mad")).alias("z"))


@query(f"""WITH RECURSIVE {_JUDGED},
a AS (SELECT reference, family, median(v) AS v, min(width) AS width, max(CAST(comparator = 'GE' AS INT)) AS ge, max(CAST(comparator = 'LE' AS INT)) AS le, CAST(substr(reference, 2) AS BIGINT) AS p FROM k GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY p, reference) AS turn FROM a),
w AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS STRUCT(f VARCHAR, v DOUBLE)[]) AS base, CAST(NULL AS VARCHAR) AS reference, CAST(0 AS BIGINT) AS p, 0 AS peers_at_time, CAST('' AS VARCHAR) AS kinds, 0 AS score, CAST('' AS VARCHAR) AS route, CAST('' AS VARCHAR) AS pile
  UNION ALL
  SELECT turn, CASE WHEN pile = 'base' THEN list_append(base, {{'f': family, 'v': v}}) ELSE base END, reference, p, peers, kind, score, route, pile
  FROM (SELECT *, CASE WHEN route <> 'close' THEN 'quarantine' WHEN p % 3 <> 0 THEN 'base' ELSE 'none' END AS pile
   FROM (SELECT *, CASE WHEN p % 19 = 0 THEN 'close' WHEN p % 7 >= 5 AND p % 5 = 0 THEN 'alert' WHEN score >= 2 AND p % 2 = 0 THEN 'watch' ELSE 'close' END AS route
    FROM (SELECT *, CAST(p % 4 + CASE WHEN kind <> '' THEN 1 ELSE 0 END AS INT) AS score
     FROM (SELECT *, CASE WHEN n < 8 THEN '' WHEN width IS NOT NULL AND hi > lo THEN CASE WHEN width / (hi - lo) <= 0.25 THEN 'narrow_band' ELSE '' END
                          WHEN mad <= 0 OR mad < 0.05 * abs(med) OR ge + le = 0 THEN '' WHEN (v - med) / mad * CASE WHEN ge = 1 THEN 1 ELSE -1 END >= 3 THEN 'extreme_threshold' ELSE '' END AS kind
      FROM (SELECT *, list_median(list_transform(vs, lambda x: abs(x - med))) * 1.4826 AS mad
       FROM (SELECT *, len(vs) AS n, list_median(vs) AS med, list_min(vs) AS lo, list_max(vs) AS hi
        FROM (SELECT o.*, base, CAST(len(base) AS INT) AS peers, list_transform(list_filter(base, lambda x: x.f = family), lambda x: x.v) AS vs FROM w JOIN o ON o.turn = w.turn + 1))))))))
SELECT '2510' AS "group", reference, CAST(p AS INT) AS place, peers_at_time, kinds, score, route, pile FROM w WHERE turn > 0""")
def tenders_in_order(spark, sf_dir):
    """ST3, ST1, J6, W12: tenders judged one after the other against the base as it stood, all of one product category."""
    told = level2.attributes_of(peered(spark, sf_dir))
    key = F.substring("reference", 2, 20).cast("long")
    t_ = told.select(
        F.lit("2510").alias("group"), "reference", key.cast("int").alias("place"), (key % 3 != 0).alias("has_docs"), (key % 19 == 0).alias("closed"), (key % 7).alias("doc_score"), (key % 4).alias("score"), (key % 5 == 0).alias("brand"), (key % 2 == 0).alias("other"), "attributes"
    )
    return incremental.walk_in_order(t_, stretch=1024).withColumn("kinds", F.concat_ws(",", "kinds"))


# ---------------------------------------------------------------- knowledge base

REGISTER = {
    "seq": "event_id", "reference": "'T' || CAST(user_id AS STRING)", "run_id": "'r' || CAST(event_id AS STRING)", "pub_date": "substr(CAST(ts AS STRING), 1, 10)", "event": "'processed'",
    "status": case("event_id % 6", "'no_documents'", "'still_open'", "'alert'", "'watch'", "'confirmed'", other="'close'"), "pile": case("event_id % 6", "'none'", "'base'", "'quarantine'", "'quarantine'", "'quarantine'", other="'base'"), "score": "CAST(event_id % 9 AS INT)", "observations": "CAST(event_id % 4 AS INT)", "note": "''",
}
_STATE = f"""{sql("ev", REGISTER, "events")}, st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY seq DESC) AS rk FROM ev) WHERE rk = 1)"""
FEEDBACK = {"seq": "c_custkey", "reference": "'T' || CAST(c_custkey % 400 AS STRING)", "verdict": case("c_custkey % 5", "'clean'", "' Confirmed '", "'clean'", "'maybe'", other="'confirmed'"), "note": "c_name"}


def register(spark, sf_dir: str) -> DataFrame:
    return made(t(spark, sf_dir, "events")[0], REGISTER)


def state(spark, sf_dir: str) -> DataFrame:
    return kb.last_event(register(spark, sf_dir), "reference", F.desc("seq"))


@query(f"""WITH {_STATE}, {sql("fb", FEEDBACK, "customer")}, l AS (SELECT reference, lower(trim(verdict)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY seq DESC) AS rk FROM fb) WHERE rk = 1),
          x AS (SELECT l.reference, v, st.status, st.pile, st.run_id, CASE v WHEN 'clean' THEN 'reviewed_clean' ELSE 'confirmed' END AS becomes, CASE WHEN v = 'confirmed' THEN 'quarantine' WHEN st.status <> 'no_documents' THEN 'base' ELSE 'none' END AS moved FROM l LEFT JOIN st USING (reference))
          SELECT reference, CASE WHEN v NOT IN ('clean', 'confirmed') THEN 'skip: verdict must be ''clean'' or ''confirmed''' WHEN run_id IS NULL THEN 'skip: not in the register' WHEN status = becomes THEN 'already applied'
                 WHEN pile <> 'quarantine' AND v = 'clean' THEN 'skip: not in quarantine (pile=' || pile || ')' ELSE v || ' -> ' || moved END AS said FROM x""")
def apply_verdicts(spark, sf_dir):
    """ST5, W3, X22: what reviewers' latest verdicts call for."""
    return kb.verdict_events(state(spark, sf_dir), made(t(spark, sf_dir, "customer")[0], FEEDBACK)).select("reference", "said")


WORK = {"reference": "'T' || CAST(c_custkey AS STRING)", "pub_date": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '2026-0' || CAST(1 + c_custkey % 9 AS STRING) END"}


@query(f"""WITH {_STATE}, {sql("nt", WORK, "customer")}, w AS (SELECT nt.* FROM nt LEFT JOIN st USING (reference) WHERE st.status IS NULL OR st.status = 'still_open' OR (st.status = 'no_documents' AND CAST(substr(reference, 2) AS BIGINT) % 2 = 0))
          SELECT reference, pub_date, row_number() OVER (ORDER BY coalesce(pub_date, '9999'), reference) AS position FROM w""")
def work_list(spark, sf_dir):
    """ST2, T4, J12: what is to be processed, in the order of publication."""
    n = made(t(spark, sf_dir, "customer")[0], WORK)
    docs = n.where("cast(substr(reference, 2) as bigint) % 2 = 0")
    out = kb.work_list(n, state(spark, sf_dir), docs)
    return selection.numbered(out, [F.coalesce("pub_date", F.lit("9999")), F.asc("reference")]).select("reference", "pub_date", "position")


@query(f"""WITH {_STATE}, {sql("fb", FEEDBACK, "customer")} SELECT reference FROM st WHERE pile = 'quarantine' AND reference NOT IN (SELECT reference FROM fb)""")
def reprocess_list(spark, sf_dir):
    """ST6: the quarantine without judged cases."""
    return kb.reprocess_list(state(spark, sf_dir), made(t(spark, sf_dir, "customer")[0], FEEDBACK), "quarantine").select("reference")


@query(f"""WITH {_STATE}, {sql("fb", FEEDBACK, "customer")} SELECT reference FROM st WHERE pile = 'quarantine' AND reference NOT IN (SELECT reference FROM fb WHERE lower(trim(verdict)) IN ('clean', 'confirmed'))""")
def to_review(spark, sf_dir):
    """Quarantined tenders without a verdict."""
    judged = made(t(spark, sf_dir, "customer")[0], FEEDBACK).where(F.lower(F.trim("verdict")).isin("clean", "confirmed"))
    return kb.reprocess_list(state(spark, sf_dir), judged, "quarantine").select("reference")


def _knowledge_base(spark, sf_dir: str) -> kb.KnowledgeBase:
    """Two runs over half of the events each, the second one replayed."""
    import uuid

    base = kb.KnowledgeBase(spark, f"{matching.shared_folder(spark)}/awardgrid/kb-{uuid.uuid4().hex}")
    events = register(spark, sf_dir).drop("run_id")
    for run, rows in (("a", events.where("seq % 2 = 0")), ("b", events.where("seq % 2 = 1")), ("b", events.where("seq % 2 = 1"))):
        last = kb.last_event(rows, "reference", F.desc("seq"))
        base.commit(run, last.select("reference", "seq"), last.select("reference", "score"), last)
    return base


_RUNS = f"""{_STATE}, tw AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS run FROM (SELECT *, row_number() OVER (PARTITION BY reference, seq % 2 ORDER BY seq DESC) AS r2 FROM ev) WHERE r2 = 1),
now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY seq DESC) AS r3 FROM tw) WHERE r3 = 1)"""


@query(f"WITH {_RUNS} SELECT reference, run AS run_id, score, status, pile FROM now")
def queue_replay(spark, sf_dir):
    """J4, ST7, S21, ST4: after committing two runs, one of them twice, the case that counts for each reference."""
    return _knowledge_base(spark, sf_dir).queue().select("reference", "run_id", "score", "status", "pile")


@query(f"WITH {_RUNS} SELECT reference, run AS run_id, seq FROM now WHERE pile IN ('base', 'quarantine')")
def current_observations(spark, sf_dir):
    """Observations of the run that counts, of tenders in the base or the quarantine."""
    return _knowledge_base(spark, sf_dir).export_rows().select("reference", "run_id", "seq")


@query(f"WITH {_RUNS} SELECT pile, status, count(*) AS tenders FROM now GROUP BY 1, 2")
def kb_status(spark, sf_dir):
    """The knowledge base by pile and status."""
    return _knowledge_base(spark, sf_dir).status_counts()


@query(f"""WITH {_O}, b AS (SELECT DISTINCT reference, substr(unspsc8, 1, 8) AS family, dimension, label FROM ob WHERE base_value IS NOT NULL)
          SELECT family, dimension, label, count(*) AS tenders FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 8 ORDER BY 4 DESC, 1 DESC, 2 DESC, 3 DESC LIMIT 15""")
def comparable_attributes(spark, sf_dir):
    """The fifteen attributes that most tenders have."""
    return kb.comparable_attributes(level2.prepare(observed(spark, sf_dir)))


# ---------------------------------------------------------------- attachments

LINKS = {
    "reference": "'T' || CAST(page_id AS STRING)", "unspsc4": "CAST(2510 + page_id % 4 AS STRING)", "pub_date": "CAST(2020 + page_id % 5 AS STRING)", "row_seq": "page_id", "unspsc": "'*' || CAST(2510 + page_id % 4 AS STRING) || '1500'", "unspsc_desc": "'*Trucks ' || CAST(page_id % 3 AS STRING)",
    "category": case("page_id % 3", "'*GD'", "'*SRV'", other="'*SRV\n*GD'"), "solicitation": "' s'", "method": "NULL", "title": "' A title '",
    "attachment": case("page_id % 5", "''", "'n/a'", "'https://portal.example/x' || CAST(page_id AS STRING) || ', https://portal.example/y'", "'https://canadabuys.canada.ca/d/RFP_' || CAST(page_id AS STRING) || '.PDF;https://canadabuys.canada.ca/d/annex a.pdf https://canadabuys.canada.ca/d/RFP_' || CAST(page_id AS STRING) || '.PDF'", other="'https://other.example/form.doc|https://canadabuys.canada.ca/d/amend-' || CAST(page_id AS STRING) || '.docx?x=1'"),
}
_L = sql("lk", LINKS, "pages")
_URLS = "list_filter(regexp_split_to_array(trim(attachment), '[,;|\\s]+'), lambda u: starts_with(u, 'http'))"
_DIRECT = f"list_filter({_URLS}, lambda u: contains(u, 'canadabuys.canada.ca'))"
_ORDERED = f"(SELECT reference, unspsc4, pub_date, row_seq, category, {_URLS} AS urls, {_DIRECT} AS direct, length(trim(attachment)) AS n FROM lk)"


def links(spark, sf_dir: str) -> DataFrame:
    return made(t(spark, sf_dir, "pages")[0], LINKS)


@query(f"""WITH {_L} SELECT reference, CASE WHEN n < 10 THEN 'none' WHEN len(direct) > 0 THEN 'direct' ELSE 'portal' END AS kind, {case("row_seq % 5", "''", "''", "''", "'https://canadabuys.canada.ca/d/RFP_' || CAST(row_seq AS VARCHAR) || '.PDF https://canadabuys.canada.ca/d/annex'", other="'https://canadabuys.canada.ca/d/amend-' || CAST(row_seq AS VARCHAR) || '.docx?x=1'")} AS urls FROM {_ORDERED}""")
def attachment_class(spark, sf_dir):
    """The links of a notice that can be fetched, once each, and its kind."""
    a = F.col("attachment")
    return links(spark, sf_dir).select("reference", attachments.attachment_kind(a).alias("kind"), F.array_join(attachments.attachment_urls(a), " ").alias("urls"))


@query(f"WITH {_L}, u AS (SELECT unnest(urls) AS u FROM {_ORDERED} WHERE n >= 10) SELECT regexp_extract(u, '^https?://([^/]+)', 1) AS host, count(*) AS links FROM u GROUP BY 1")
def attachment_hosts(spark, sf_dir):
    """Links by host."""
    return attachments.host_counts(links(spark, sf_dir))


_CANDIDATES = f"""{_L}, cd AS (SELECT *, contains(category, 'GD') AS goods FROM {_ORDERED} WHERE len(direct) > 0)"""


@query(f"""WITH {_CANDIDATES}, g AS (SELECT unspsc4, count(*) AS tenders FROM cd WHERE goods OR reference = 'T9' GROUP BY 1), f AS (SELECT unspsc4, arg_min('Trucks ' || CAST(row_seq % 3 AS VARCHAR), row_seq) AS label FROM cd WHERE goods OR reference = 'T9' GROUP BY 1)
          SELECT unspsc4, tenders, label FROM g JOIN f USING (unspsc4)""")
def attachment_candidates(spark, sf_dir):
    """Categories by tenders whose attachments can be fetched; one asked for by name needn't be goods."""
    return attachments.scan_candidates(links(spark, sf_dir), references=["T9"])[1]


@query(f"""WITH {_CANDIDATES}, r AS (SELECT unspsc4, reference, row_number() OVER (PARTITION BY unspsc4 ORDER BY pub_date, reference) - 1 AS pos, count(*) OVER (PARTITION BY unspsc4) AS n FROM cd WHERE goods), i AS (SELECT unnest(range(0, 7)) AS i)
          SELECT DISTINCT unspsc4, reference FROM r, i WHERE n <= 7 OR pos = (i * n) // 7""")
def picked_tenders(spark, sf_dir):
    """Seven evenly spread tenders of each category."""
    return attachments.pick(attachments.scan_candidates(links(spark, sf_dir))[0], 7, "spread").select("unspsc4", "reference")


@query(f"""WITH {_CANDIDATES} SELECT reference, 'https://canadabuys.canada.ca/d/RFP_' || CAST(row_seq AS VARCHAR) || '.PDF' AS url, 1 AS rank, 2 AS nth, '02_RFP_' || CAST(row_seq AS VARCHAR) || '.pdf' AS file_name FROM cd WHERE goods AND row_seq % 5 = 3 AND row_seq % 2 = 0
          UNION ALL SELECT reference, 'https://canadabuys.canada.ca/d/annex', 0, 1, '01_annex' FROM cd WHERE goods AND row_seq % 5 = 3 AND row_seq % 2 = 0
          UNION ALL SELECT reference, 'https://canadabuys.canada.ca/d/amend-' || CAST(row_seq AS VARCHAR) || '.docx?x=1', 3, 1, '01_amend-' || CAST(row_seq AS VARCHAR) || '.docx' FROM cd WHERE goods AND row_seq % 5 = 4 AND row_seq % 2 = 0""")
def fetch_list(spark, sf_dir):
    """Links in the order to fetch, with file names, but for those that were fetched."""
    wanted = attachments.fetch_list(attachments.scan_candidates(links(spark, sf_dir))[0])
    odd = wanted.withColumn("k", F.substring("reference", 2, 20).cast("long"))
    # odd tenders' links were fetched, at first with an error; of the others some failed or left no bytes
    bad = odd.select("url", F.lit(1).alias("seq"), F.lit("p").alias("local_path"), F.lit(5).alias("bytes"), F.lit("HTTP 500").alias("error")).where("url <> 'https://canadabuys.canada.ca/d/annex'")
    good = odd.where("k % 2 = 1 and url <> 'https://canadabuys.canada.ca/d/annex'").select("url", F.lit(2).alias("seq"), F.lit("p").alias("local_path"), F.lit(5).alias("bytes"), F.lit("").alias("error"))
    left = attachments.not_fetched(odd, bad.unionByName(good))
    return left.where("k % 2 = 0").select("reference", "url", "rank", "nth", "file_name")


_FILES = {"page_id": "page_id", "name": case("page_id % 9", "'Amendment 001.pdf'", "'Annex_A.pdf'", "'Statement-of-Work.docx'", "'RFP_modif.pdf'", "'RFSA 2.pdf'", "'bid_submission.xls'", "'prices.xlsx'", "'photo.png'", other="'devis.pdf'")}


@query(f"WITH {sql('f', _FILES, 'pages')} SELECT page_id, {case('page_id % 9', *[chr(39) + x + chr(39) for x in ('amendment', 'spec', 'spec', 'amendment', 'solicitation', 'form', 'form', 'other')], other=chr(39) + 'spec' + chr(39))} AS role, {case('page_id % 9', '3', '0', '0', '1', '1', '2', '4', '2', other='0')} AS rank FROM f")
def document_role(spark, sf_dir):
    """P10: what a file's name says it is, and when it is fetched; the first pattern counts."""
    f = made(t(spark, sf_dir, "pages")[0], _FILES)
    return f.select("page_id", attachments.document_role(F.col("name")).alias("role"), attachments.attachment_rank(F.col("name")).alias("rank"))


_COMPONENTS = {"page_id": "page_id", "name": case("page_id % 5", "' a/b: c?.pdf '", "'..hidden  file. '", "''", "NULL", other="'plain-' || CAST(page_id AS STRING) || '.txt'")}


@query(f"WITH {sql('f', _COMPONENTS, 'pages')} SELECT page_id, {case('page_id % 5', chr(39) + 'a_b__c_.pdf' + chr(39), chr(39) + 'hidden_file' + chr(39), chr(39) + 'unnamed' + chr(39), chr(39) + 'unnamed' + chr(39), other='name')} AS name FROM f")
def safe_names(spark, sf_dir):
    """File names without unsafe characters."""
    return made(t(spark, sf_dir, "pages")[0], _COMPONENTS).select("page_id", names.safe_component(F.col("name")).alias("name"))


# ---------------------------------------------------------------- decisions and evaluation

ALIASES = {"seq": "c_custkey", "winner": "'W' || CAST(c_custkey % 50 AS STRING)", "name": "'N' || CAST(c_custkey % 7 AS STRING)", "verdict": "CASE WHEN c_custkey % 3 = 0 THEN 'same' ELSE 'different' END", "decided_by": "CASE WHEN c_nationkey % 6 = 0 THEN 'auditor' ELSE 'agent' END"}


@query(f"WITH {sql('a', ALIASES, 'customer')} SELECT winner, name, verdict, decided_by, seq FROM (SELECT *, row_number() OVER (PARTITION BY winner, name ORDER BY CASE decided_by WHEN 'auditor' THEN 0 ELSE 1 END, seq DESC) AS rk FROM a) WHERE rk = 1")
def current_aliases(spark, sf_dir):
    """The decision that counts for each spelling: an auditor's before an agent's."""
    return agents.current_aliases(made(t(spark, sf_dir, "customer")[0], ALIASES)).select("winner", "name", "verdict", "decided_by", "seq")


_MERGES = {"s_suppkey": "s_suppkey", "winner": case("s_suppkey % 4", "'ACME TOOLS'", "'ACME TOOLS CANADA'", "'BELL JOINT VENTURE'", other="'NORTH'"), "name": case("s_suppkey % 5", "'ACME TOOLS CANADA'", "'ACME JOINT VENTURE'", "'ZED'", "'NORTH GROUP'", other="'ACME TOOLS'"), "code": "'K' || CAST(s_suppkey % 3 AS STRING)"}


@query(f"""WITH {sql('m', _MERGES, 'supplier')} SELECT s_suppkey, CASE WHEN contains(name, 'JOINT VENTURE') AND NOT contains(winner, 'JOINT VENTURE') THEN 'venture' WHEN code = 'K1' OR replace(replace(winner, ' CANADA', ''), ' GROUP', '') = replace(replace(name, ' CANADA', ''), ' GROUP', '') THEN 'allowed' ELSE 'apart' END AS ruled FROM m""")
def merge_rules(spark, sf_dir):
    """What the code rules about two names, whatever a model says."""
    m = made(t(spark, sf_dir, "supplier")[0], _MERGES)
    why = agents.refused_merge(F.col("winner"), F.col("name"), F.array(F.lit("K1")), F.array("code"))
    return m.select("s_suppkey", F.when(why.startswith("a joint"), "venture").when(why.isNull(), "allowed").otherwise("apart").alias("ruled"))


_LABELLED = {"seq": "doc_id", "reference": "'T' || CAST(doc_id % 50 AS STRING)", "name": case("doc_id % 5", "'Honda'", "'Leica TS16'", "'honda gx390'", "'Zed'", other="'Palfinger'"), "letter": case("toxic + quality * 2", "'F'", "' e'", "'f '", other="'x'"), "split": "CASE WHEN doc_id % 3 = 0 THEN ' tuning ' ELSE '' END"}
_LEVEL = {"seq": "p_partkey", "reference": "'T' || CAST(p_partkey % 50 AS STRING)", "name": case("p_partkey % 4", "'Honda GX390'", "'Leica'", "'Palfinger'", other="'Ford'"), "result": case("p_partkey % 7", "'finding'", "'ok'", "'unresolved'", "'dropped'", "'ok'", other="'unresolved'"), "status": case("p_partkey % 7", "'BRAND_WITHOUT_EQUIVALENT'", "'OK_MAKE_LIST'", other="'AGENT_B'"), "letter": "CASE WHEN p_partkey % 7 = 4 THEN 'b' END"}
_GIVEN = f"""{sql("lb0", _LABELLED, "labels")}, {sql("lv", _LEVEL, "part")},
lb AS (SELECT seq, reference, name, lower(trim(letter)) AS letter, coalesce(nullif(trim(split), ''), 'holdout') AS split FROM lb0 WHERE lower(trim(letter)) IN ('a', 'b', 'c', 'd', 'e', 'f')),
mt AS (SELECT lb.seq, arg_min(CASE lv.result WHEN 'finding' THEN 'f' WHEN 'ok' THEN coalesce(lv.letter, CASE lv.status WHEN 'OK_MAKE_LIST' THEN 'd' ELSE lv.status END) ELSE 'unresolved' END, CASE lv.result WHEN 'finding' THEN 0 WHEN 'ok' THEN 1 ELSE 2 END * 1000000000 + lv.seq) AS got
       FROM lb JOIN lv ON lb.reference = lv.reference AND lv.result <> 'dropped' AND (contains(lower(lb.name), lower(lv.name)) OR contains(lower(lv.name), lower(lb.name))) GROUP BY 1),
gv AS (SELECT lb.*, coalesce(mt.got, 'not a candidate') AS got FROM lb LEFT JOIN mt USING (seq))"""


def _given(spark, sf_dir: str) -> DataFrame:
    rows = evaluation.load_labels([(made(t(spark, sf_dir, "labels")[0], _LABELLED), "holdout")])
    return evaluation.letters_given(rows, made(t(spark, sf_dir, "part")[0], _LEVEL))


@query(f"WITH {_GIVEN} SELECT seq, reference, name, letter, split, got FROM gv")
def label_detector(spark, sf_dir):
    """Labelled names with the letter that level one gave them."""
    return _given(spark, sf_dir).select("seq", "reference", "name", "letter", "split", "got")


@query(f"""WITH {_GIVEN} SELECT split, count(*) AS cases, count_if(letter = got) AS letter_right, count_if((letter = 'f') = (got = 'f')) AS finding_right, count_if(letter = 'f') AS lock_ins, count_if(got = 'f') AS findings, count_if(letter = 'f' AND got = 'f') AS true_findings,
          CASE WHEN count_if(got = 'f') > 0 THEN count_if(letter = 'f' AND got = 'f') / count_if(got = 'f') END AS precision, CASE WHEN count_if(letter = 'f') > 0 THEN count_if(letter = 'f' AND got = 'f') / count_if(letter = 'f') END AS recall FROM gv GROUP BY 1""")
def finding_scores(spark, sf_dir):
    """Precision and recall of findings by split."""
    return evaluation.finding_scores(_given(spark, sf_dir))


COPIES = {"reference": "'S' || CAST(doc_id AS STRING)", "variant": case("doc_id % 7", "'A'", "'B'", "'C'", "'D'", "'E'", "'F'", other="'G'"), "base": "'B' || CAST(doc_id % 30 AS STRING)", "expected": case("doc_id % 7", "'watch'", "'alert'", "'alert'", "'close'", "'close'", "'close'", other="'watch'"), "style": "lang", "one": "CASE WHEN doc_id % 7 = 5 THEN NULL ELSE 'Honda' END"}
_COPIED = f"""{sql("cp", COPIES, "documents")}, ce AS (SELECT *, CAST(substr(base, 2) AS INT) % 4 = 0 AS allows FROM cp), cx AS (SELECT * REPLACE (CASE WHEN allows THEN 'close' ELSE expected END AS expected), variant IN ('A', 'B', 'C', 'G') AND NOT allows AS rigged FROM ce),
ck AS (SELECT reference, CAST(substr(reference, 2) AS BIGINT) AS k FROM cx), rt AS (SELECT reference, CASE k % 5 WHEN 0 THEN 'alert' WHEN 1 THEN 'watch' ELSE 'close' END AS route, CASE k % 4 WHEN 0 THEN 'finding' WHEN 1 THEN 'cleared' WHEN 2 THEN 'open' ELSE 'dropped' END AS result FROM ck)"""


def _copies(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = made(t(spark, sf_dir, "documents")[0], COPIES).withColumn("brands", F.array_compact(F.array("one"))).drop("one")
    ids = spark.range(30).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("reference"), (F.col("id") % 8 == 0).alias("blanket"), F.lit(False).alias("equivalent_products"))
    hand = spark.range(4, 30, 8).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("base"), F.lit("Yes").alias("allows"))
    copies = evaluation.expected_routes(c, ids, hand)
    k = F.substring("reference", 2, 20).cast("long")
    cases = copies.select("reference", F.when(k % 5 == 0, "alert").when(k % 5 == 1, "watch").otherwise("close").alias("route"))
    result = F.when(k % 4 == 0, "finding").when(k % 4 == 1, "cleared").when(k % 4 == 2, "open").otherwise("dropped")
    checked = copies.select("reference", F.lit("Honda GX390").alias("name"), result.alias("result"), F.when(result == "cleared", "OK_MAKE_LIST").alias("status"), F.lit(1).alias("place"))
    return copies, cases, checked


@query(f"WITH {_COPIED} SELECT variant, allows, max(expected) AS expected, count_if(route = 'alert') AS alert, count_if(route = 'watch') AS watch, count_if(route = 'close') AS close, count_if(route = expected) AS as_expected, count(*) AS copies FROM cx JOIN rt USING (reference) GROUP BY 1, 2")
def routing_report(spark, sf_dir):
    """Copies of tenders by variant, how many came to each route and how many as expected."""
    copies, cases, _ = _copies(spark, sf_dir)
    return evaluation.routing_report(copies, cases)


@query(f"""WITH {_COPIED}, o AS (SELECT cx.*, CASE result WHEN 'finding' THEN 'found' WHEN 'cleared' THEN 'cleared_make_list' WHEN 'open' THEN 'brand_not_confirmed' ELSE 'not_picked_up' END AS outcome FROM cx JOIN rt USING (reference) WHERE one IS NOT NULL AND rigged),
          v AS (SELECT 'outcome' AS view, outcome AS value, outcome FROM o UNION ALL SELECT 'style', style, outcome FROM o UNION ALL SELECT 'cache', 'confirmed', outcome FROM o) SELECT view, value, count(*) AS brands, count_if(outcome = 'found') AS found FROM v GROUP BY 1, 2""")
def outcome_report(spark, sf_dir):
    """What became of the brands that were put into copies."""
    copies, _, checked = _copies(spark, sf_dir)
    return evaluation.outcome_report(copies, evaluation.brand_outcomes(copies, checked), spark.createDataFrame([("honda", True)], "key string, brand boolean"))


@query(f"WITH {_COPIED} SELECT variant, count(*) AS copies, count_if(result = 'finding') AS flagged FROM cx JOIN rt USING (reference) WHERE NOT rigged AND variant <> 'F' GROUP BY 1")
def false_alarms(spark, sf_dir):
    """Copies that should close with a finding on a brand that was put in."""
    copies, _, checked = _copies(spark, sf_dir)
    return evaluation.false_alarms(copies, checked.where("result = 'finding'"))


@query("""WITH m AS (SELECT doc_id, toxic = 1 AS truth, quality = 0 AS off, quality = 0 AND toxic = 1 AS fixed, doc_id % 3 = 0 AS model FROM labels),
          x AS (SELECT 'off' AS mode, off AS f, FALSE AS d, truth FROM m UNION ALL SELECT 'fixed', fixed, fixed <> off, truth FROM m UNION ALL SELECT 'model', model, model <> off, truth FROM m)
          SELECT mode, count_if(f) AS flagged, count_if(f AND truth) AS hits, count_if(f AND NOT truth) AS false_alarms, count_if(d) AS differs FROM x GROUP BY 1""")
def mode_comparison(spark, sf_dir):
    """Modes of the second look on the same labels."""
    m = t(spark, sf_dir, "labels")[0].selectExpr("toxic = 1 AS lock_in", "quality = 0 AS off", "quality = 0 AND toxic = 1 AS fixed", "doc_id % 3 = 0 AS model")
    return evaluation.mode_report(m, ["off", "fixed", "model"])


_PHRASES = {"p_partkey": "p_partkey", "style": case("p_partkey % 7", *[f"'{s}'" for s in evaluation.STYLES]), "equivalent": "p_partkey % 2 = 0"}
_OE = "CASE WHEN equivalent THEN ' or equivalent' ELSE '' END"


@query(f"""WITH {sql('f', _PHRASES, 'part')} SELECT p_partkey, CASE style WHEN 'prose' THEN 'The engine must be a Honda GX390' || {_OE} || '.' WHEN 'table' THEN 'Engine~Honda GX390' || {_OE} WHEN 'field' THEN 'Engine - make and model: Honda GX390' || {_OE} WHEN 'trademark' THEN 'The engine shall be a Honda® GX390' || {_OE} || '.'
          WHEN 'oem' THEN 'Only a genuine Honda GX390 engine' || {_OE} || ' will be accepted.' WHEN 'no_model' THEN 'The engine must be manufactured by Honda' || {_OE} || '.' ELSE 'Le moteur doit être un Honda GX390' || CASE WHEN equivalent THEN ' ou équivalent' ELSE '' END || '.' END AS lines FROM f""")
def brand_phrases(spark, sf_dir):
    """the seven wordings of a brand."""
    f = made(t(spark, sf_dir, "part")[0], _PHRASES)
    lines = evaluation.phrase(F.col("style"), F.lit("Honda"), F.lit("GX390"), F.lit("engine"), F.lit("moteur"), F.col("equivalent"))
    return f.select("p_partkey", F.array_join(lines, "~").alias("lines"))


_LOG = {"ts": "CAST(ts AS STRING)", "tag": "CASE WHEN event_type = 'click' THEN '' ELSE event_type END", "total_tokens": case("event_id % 5", "''", "'x'", "'12.0'", other="CAST(event_id % 900 AS STRING)"), "cached": "CASE WHEN event_id % 4 = 0 THEN '1' ELSE '' END", "k": "event_id"}


@query(f"""WITH {sql('l', _LOG, 'events')} SELECT CASE WHEN tag = '' THEN 'other' ELSE tag END AS agent, substr(ts, 1, 10) AS day, count(*) AS calls, count_if(cached = '1') AS cached, CAST(sum(CASE WHEN cached = '1' OR k % 5 IN (0, 1) THEN 0 WHEN k % 5 = 2 THEN 12 ELSE k % 900 END) AS BIGINT) AS tokens FROM l GROUP BY 1, 2""")
def usage_by_day(spark, sf_dir):
    """Model calls and tokens paid, by agent and day."""
    return feeds.usage_by_agent(made(t(spark, sf_dir, "events")[0], _LOG), "2026-01-01").select("agent", "day", "calls", "cached", "tokens")


_RUNS_OF = {"conv_id": "conv_id", "turn": "turn", "stop": case("conv_id % 4", "'model unavailable: quota'", "'step budget used'", "NULL", other="'finished by the model'"), "line": case("conv_id % 5", "'agent could not start (no key) - kept'", "'agent: nothing for it to check'", "'--agent asked but no LLM key is set'", other="'read 3 document(s)'")}


@query(f"""WITH {sql('r', _RUNS_OF, 'conversations')} SELECT conv_id, turn, CASE WHEN stop LIKE 'model%' THEN 'incomplete: ' || stop WHEN stop IS NOT NULL THEN 'ran' WHEN conv_id % 5 = 0 THEN 'did not run: no key' WHEN conv_id % 5 = 1 THEN 'ran (nothing to check)' WHEN conv_id % 5 = 2 THEN 'did not run: no LLM key' ELSE 'ran (rules cleared everything)' END AS status FROM r""")
def agent_statuses(spark, sf_dir):
    """Whether the agent judged a tender, from its stop reason or the trace."""
    r = made(t(spark, sf_dir, "conversations")[0], _RUNS_OF)
    return r.select("conv_id", "turn", agents.agent_status(F.col("stop"), F.array(F.lit("read"), "line")).alias("status"))


@query(f"""WITH {sql('r', _RUNS_OF, 'conversations')} SELECT stop, count(*) AS runs, avg(turn) AS average_steps, max(turn) AS most_steps FROM r WHERE stop IS NOT NULL GROUP BY 1""")
def agent_runs(spark, sf_dir):
    """How agents' runs ended, with their steps."""
    r = made(t(spark, sf_dir, "conversations")[0], _RUNS_OF)
    return agents.run_statistics(r.where("stop is not null").select("stop", F.col("turn").alias("steps")))


_FOUND = {"reference": "'T' || CAST(p_partkey % 200 AS STRING)", "brand": "p_brand || ' ' || CAST(p_partkey AS STRING)", "letter": "CASE WHEN p_partkey % 4 = 0 THEN 'f' END", "confidence": "'medium'", "line_no": "CAST(p_size AS INT)", "file": "'a'", "line": "p_name", "k": "p_partkey"}
_RECHECK = f"""{sql('fd', _FOUND, 'part')}, rr AS (SELECT *, CAST(substr(reference, 2) AS INT) % 3 = 0 AS asked, CASE k % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'c' END AS said FROM fd)"""


def _recheck(spark, sf_dir: str):
    f = made(t(spark, sf_dir, "part")[0], _FOUND)
    ref = F.substring("reference", 2, 10).cast("int") % 3 == 0
    said = F.when(F.col("k") % 3 == 0, "f").when(F.col("k") % 3 == 1, "c")
    v = f.where(ref).select("reference", F.when(said.isNotNull(), F.col("brand")).alias("brand"), said.alias("letter"), F.lit("the quote").alias("quote"), F.lit("b").alias("document"), F.lit(7).alias("at_line"))
    return agents.apply_recheck(f.drop("k"), v)


@query(f"WITH {_RECHECK} SELECT reference, brand, CASE WHEN asked AND letter IS NULL THEN 'f' ELSE letter END AS letter, CASE WHEN asked AND letter IS NULL THEN 'high' ELSE confidence END AS confidence, CASE WHEN asked AND letter IS NULL THEN 7 ELSE line_no END AS line_no FROM rr WHERE NOT (asked AND letter IS NULL AND coalesce(said, '') <> 'f')")
def rechecked_findings(spark, sf_dir):
    """Findings that a second look leaves."""
    return _recheck(spark, sf_dir)[0].select("reference", "brand", "letter", "confidence", "line_no")


@query(f"""WITH {_RECHECK} SELECT reference, brand, CASE said WHEN 'f' THEN 'kept' WHEN 'c' THEN 'cleared' ELSE 'unresolved' END AS result, CASE said WHEN 'f' THEN '''' || brand || ''' was re-read by the spec agent: required, no equivalent accepted (“the quote”, b, line 7).' WHEN 'c' THEN '''' || brand || ''' was re-read by the spec agent and removed - the buyer''s own equipment: “the quote” (b, line 7).'
          ELSE '''' || brand || ''' was re-read by the spec agent but could not be settled; it no longer counts.' END AS text FROM rr WHERE asked AND letter IS NULL""")
def recheck_notes(spark, sf_dir):
    """What a second look says of each name."""
    return _recheck(spark, sf_dir)[1].select("reference", "brand", "result", "text")


_MERGED = {"reference": "'T' || CAST(p_partkey % 300 AS STRING)", "seq": "p_partkey", "name": case("p_partkey % 8", "'Formlabs'", "'FormLabs Form'", "'Formlabs form 3'", "'General Electric'", "'General Motors'", "'General'", other="'Acme ' || CAST(p_partkey AS STRING)"), "occurrences": "CAST(p_size AS BIGINT)", "result": case("p_partkey % 3", "'finding'", "'ok'", other="'unresolved'"), "status": "NULL", "decided_by": "'rule'"}
_HOSTED = f"""{sql('fd', _MERGED, 'part')}, w AS (SELECT *, regexp_extract_all(lower(name), '[0-9a-zà-ÿ]+') AS ws FROM fd),
h AS (SELECT a.reference, a.seq, arg_min(b.seq, len(b.ws) * 10000000 + b.seq) AS host FROM w a JOIN w b ON a.reference = b.reference AND a.ws[1:len(b.ws)] = b.ws AND (len(b.ws) < len(a.ws) OR (len(b.ws) = len(a.ws) AND b.seq < a.seq)) GROUP BY 1, 2),
g AS (SELECT w.*, coalesce(h.host, w.seq) AS host FROM w LEFT JOIN h USING (reference, seq))"""


@query(f"WITH {_HOSTED} SELECT g.reference, g.name, CAST(sum(m.occurrences) AS BIGINT) AS occurrences, coalesce(string_agg(m.name, '|' ORDER BY len(m.ws), m.seq) FILTER (WHERE m.seq <> g.seq), '') AS also_written FROM g JOIN g m ON m.reference = g.reference AND m.host = g.seq WHERE g.host = g.seq GROUP BY g.reference, g.seq, g.name")
def merged_spellings(spark, sf_dir):
    """A name joins the shortest one of its tender that it begins with."""
    out = brands.merge_spellings(made(t(spark, sf_dir, "part")[0], _MERGED))
    return out.select("reference", "name", "occurrences", F.array_join("also_written", "|").alias("also_written"))


@query(f"""WITH {sql('fd', _MERGED, 'part')} SELECT reference, name, CASE result WHEN 'unresolved' THEN 'open' WHEN 'ok' THEN 'cleared' ELSE result END AS result, row_number() OVER (PARTITION BY reference ORDER BY CASE result WHEN 'finding' THEN 0 WHEN 'unresolved' THEN 1 ELSE 2 END, seq) AS place FROM fd""")
def names_checked(spark, sf_dir):
    """All names of a tender with who settled them, findings first."""
    rows = made(t(spark, sf_dir, "part")[0], _MERGED).withColumn("also_written", F.array().cast("array<string>"))
    return brands.names_checked(rows).select("reference", "name", "result", "place")


_ENTRIES = {
    "key": "'n' || CAST(p_partkey % 600 AS STRING)", "rank": "p_partkey", "label": case("p_partkey % 4", "'N' || CAST(p_partkey % 600 AS STRING)", "'n' || CAST(p_partkey % 600 AS STRING)", "'Other'", other="'N' || CAST(p_partkey % 600 AS STRING)"),
    "description": case("p_size % 5", "'company of engines'", "'family name'", "'a tool'", "'village in France'", other="'brand of tea'"), "match": "CASE WHEN p_partkey % 11 = 0 THEN 'n' || CAST(p_partkey % 600 AS STRING) END",
}
_BRAND, _NOT, _PERSON = "company|brand", "village|family name", "family name"


@query(f"""WITH {sql('e', _ENTRIES, 'part')}, x AS (SELECT *, regexp_matches(description, '{_BRAND}') AND NOT regexp_matches(description, '{_NOT}') AND substr(label, 1, 1) <> 'n' AS company, substr(label, 1, 1) = 'n' AND NOT regexp_matches(description, '{_NOT}') AND label = key AS word, regexp_matches(description, '{_PERSON}') AS person, regexp_matches(description, '{_NOT}') AS no FROM e WHERE lower(label) = key OR match = key),
          g AS (SELECT key, bool_or(company) AS c, bool_or(word AND NOT company) AS o, bool_and(person) AS p, bool_and(no) AS n FROM x GROUP BY 1)
          SELECT k.key, CASE WHEN c AND NOT o THEN TRUE WHEN NOT c AND NOT o AND NOT p AND n THEN FALSE END AS brand FROM (SELECT DISTINCT key FROM e) k LEFT JOIN g USING (key)""")
def brand_verdicts(spark, sf_dir):
    """whether a name is a brand, from knowledge-base entries that carry it."""
    return brands.brand_verdict(made(t(spark, sf_dir, "part")[0], _ENTRIES), _BRAND, _NOT, _PERSON).select("key", "brand")


_CACHE = {"key": "'k' || CAST(p_partkey AS STRING)", "brand": case("p_partkey % 3", "TRUE", "FALSE", other="NULL"), "label": "CASE WHEN p_size % 4 = 0 THEN 'axis' ELSE 'Axis' END", "description": case("p_size % 3", "'family name'", "'(no exact match on Wikidata)'", other="'a firm of some kind'"), "v": "3 + p_partkey % 4"}


@query(f"""WITH {sql('c', _CACHE, 'part')} SELECT key, CASE WHEN brand AND label = 'axis' THEN NULL WHEN description LIKE '(no%' AND NOT (v = 6 OR (v IN (4, 5) AND brand IS NOT NULL)) THEN NULL WHEN NOT brand AND description = 'family name' THEN NULL ELSE brand END AS brand FROM c""")
def cached_verdicts(spark, sf_dir):
    """verdicts of a cache as an offline reader takes them."""
    return brands.cached_verdict(made(t(spark, sf_dir, "part")[0], _CACHE), _PERSON)


_QUOTES = {"reference": "'T' || CAST(p_partkey % 100 AS STRING)", "k": "p_partkey", "file": "CASE WHEN p_partkey % 5 = 0 THEN 'gone.txt' ELSE 'doc' || CAST(p_partkey % 2 AS STRING) END", "line": case("p_partkey % 6", "'must be a CRANE'", "'crane ... of steel'", "'steel ... crane'", "'no such'", "''", other="'abc'")}


@query(f"WITH {sql('q', _QUOTES, 'part')} SELECT k, CASE WHEN k % 6 IN (0, 1) THEN k % 5 = 0 OR k % 2 = 0 ELSE FALSE END AS checked FROM q")
def checked_sources(spark, sf_dir):
    """Whether a finding's words stand in the document it names, or in any if there is none."""
    q = made(t(spark, sf_dir, "part")[0], _QUOTES)
    docs = spark.range(100).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("reference"), F.explode(F.array(F.struct(F.lit("doc0").alias("document"), F.lit("It must be\na crane, made of  steel.").alias("text")), F.struct(F.lit("doc1").alias("document"), F.lit("Nothing here").alias("text")))).alias("d")).select("reference", "d.*")
    return quotes.check_sources(q, docs).select("k", "checked")


_SHAPES = {"p_partkey": "p_partkey", "text": case("p_partkey % 5", "'An Agilent 8890A and Annex B12 or Agilent 8890A'", "'See W8486 E60HP-11000, Bldg AB123'", "'Eppendorf model CR5920 and May AB12'", "''", other="'Leica TS16 and Leica TS16P'")}


@query(f"WITH {sql('s', _SHAPES, 'part')} SELECT p_partkey, {case('p_partkey % 5', chr(39) + 'Agilent 8890A' + chr(39), chr(39)*2, chr(39) + 'Eppendorf CR5920' + chr(39), chr(39)*2, other=chr(39) + 'Leica TS16,Leica TS16P' + chr(39))} AS shapes FROM s")
def brand_shapes(spark, sf_dir):
    """Brand and model shapes, without words that lead clauses and solicitation numbers."""
    s = made(t(spark, sf_dir, "part")[0], _SHAPES)
    return s.select("p_partkey", F.array_join(F.transform(brands.brand_models(F.col("text")), lambda x: F.concat(x["lead"], F.lit(" "), x["model"])), ",").alias("shapes"))


_MEASURED = {"p_partkey": "p_partkey", "pages": case("p_partkey % 4", "0", "NULL", "10", other="2"), "chars": "p_size * 40", "req_lines": "p_size % 12", "constrained": "p_size % 7", "sections": "p_partkey % 3"}


@query(f"""WITH {sql('m', _MEASURED, 'part')} SELECT p_partkey, CASE WHEN coalesce(pages, 0) > 0 AND chars / pages < 120 THEN 'SCANNED' WHEN coalesce(pages, 0) = 0 AND chars < 200 THEN 'NO_TEXT' WHEN req_lines >= 8 AND constrained >= 4 THEN 'SPEC_RICH' WHEN req_lines >= 3 OR sections >= 1 THEN 'SPEC_THIN' ELSE 'NO_SPEC' END AS verdict FROM m""")
def document_verdicts(spark, sf_dir):
    """what kind of document it is, from its measures."""
    m = made(t(spark, sf_dir, "part")[0], _MEASURED)
    return m.select("p_partkey", brands.document_verdict(*[F.col(c) for c in ("pages", "chars", "req_lines", "constrained", "sections")]).alias("verdict"))
