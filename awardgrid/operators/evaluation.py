"""How well the detectors do: labelled names, held-out samples, and copies of tenders with brands put in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardgrid.functions import names
from awardgrid.operators.brands import platform

# Fixed values.
LETTERS = ("a", "b", "c", "d", "e", "f")
STATUS_LETTER = {"OK": "e", "OK_EQUIV_PRODUCTS_CLAUSE": "e", "OK_BLANKET_CLAUSE": "e", "OK_PDF_ORDER": "e", "OK_BUYER_EQUIPMENT": "c", "OK_MAKE_LIST": "d", "OK_PLATFORM": "c", "OK_LLM_CLEARED": "cleared by the LLM judge"}
SAMPLED = 12
COMMON_WORDS = ("these", "model", "series", "from", "form")
STYLES = ("prose", "table", "field", "trademark", "oem", "no_model", "french")
VARIANTS = {"A": "watch", "B": "alert", "C": "alert", "D": "close", "E": "close", "F": "close", "G": "watch"}
RIGGED = ("A", "B", "C", "G")
OUTCOME = {
    "OK": "or_equivalent_nearby", "OK_BLANKET_CLAUSE": "blanket_clause", "OK_MAKE_LIST": "make_list", "OK_EQUIV_PRODUCTS_CLAUSE": "equiv_products_clause",
    "AGENT_A": "agent_a_not_a_brand", "AGENT_B": "agent_b_bidder", "AGENT_C": "agent_c_buyer_equipment", "AGENT_D": "agent_d_list_of_brands", "AGENT_E": "agent_e_equivalent_accepted",
}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def load_labels(files: list[tuple[DataFrame, str]], split: str = "all") -> DataFrame:
    """Labelled names of several files, each with the split of rows that name none; only valid letters."""
    out = None
    for rows, default in files:
        own = rows if "split" in rows.columns else rows.withColumn("split", F.lit(None).cast("string"))
        own = own.withColumns({"split": F.trim(F.coalesce(F.when(F.trim("split") != "", F.col("split")), F.lit(default))), "letter": F.lower(F.trim(F.coalesce("letter", F.lit(""))))})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    out = out.where(F.col("letter").isin(*LETTERS))
    return out if split == "all" else out.where(F.col("split") == split)


def letters_given(labels: DataFrame, level: DataFrame) -> DataFrame:
    """Labels (reference, name, ...) with ``got``: the letter that level one gave the name, or why it gave none.

    A name is met by a result whose name contains it or is contained in it. Findings come first, then
    cleared names (with their model's letter, else what the clearance means), then open ones; the first
    in level's order ``seq`` counts. Each different name of a tender is compared once, however many rows have it.
    """
    order = F.when(F.col("v.result") == "finding", 0).when(F.col("v.result") == "ok", 1).otherwise(2)
    rows = labels.withColumn("_name", F.lower("name"))
    cleared = F.coalesce(F.when(F.col("v.letter") != "", F.col("v.letter")), _lookup(STATUS_LETTER, F.col("v.status")), F.col("v.status"))
    got = F.when(F.col("v.result") == "finding", "f").when(F.col("v.result") == "ok", cleared).otherwise("unresolved")
    known = level.where(F.col("result") != "dropped").alias("v").groupBy("reference", F.lower("name").alias("b")).agg(F.min(F.struct(order.alias("o"), F.col("v.seq"), got.alias("got"))).alias("first"))
    asked = rows.select("reference", F.col("_name").alias("a")).distinct()
    met = asked.join(known, "reference").where(F.contains("a", "b") | F.contains("b", "a"))
    best = met.groupBy("reference", F.col("a").alias("_name")).agg(F.min("first").alias("first")).select("reference", "_name", "first.got")
    out = rows.join(best, ["reference", "_name"], "left").withColumn("got", F.coalesce("got", F.lit("not a candidate")))
    return out.select(*labels.columns, "got")


def finding_scores(rows: DataFrame) -> DataFrame:
    """Per split: cases, right letters and findings, precision and recall of f. rows: split, letter (expected), got."""
    want, got = F.col("letter") == "f", F.col("got") == "f"
    out = rows.groupBy("split").agg(
        F.count("*").alias("cases"), F.count_if(F.col("letter") == F.col("got")).alias("letter_right"), F.count_if(want == got).alias("finding_right"), F.count_if(want).alias("lock_ins"),
        F.count_if(got).alias("findings"), F.count_if(want & got).alias("true_findings"),
    )
    rate = lambda c: F.when(F.col(c) > 0, F.col("true_findings") / F.col(c))
    return out.withColumn("precision", rate("findings")).withColumn("recall", rate("lock_ins"))


def _long_words(name: Column) -> Column:
    plain = F.filter(F.split(F.lower(name), r"(?U)[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON_WORDS))
    return F.array_distinct(plain)


def holdout_sample(kept: DataFrame, found: DataFrame, open_names: DataFrame, seen: DataFrame, tuned: DataFrame, seed: int = 20261101, most: int = SAMPLED) -> DataFrame:
    """Names to be lettered that nothing was tuned on: lettered rows as they are, and new candidates.

    kept: reference, name, letter. found (agent and rule findings) and open_names: group, reference,
    name, seq, source. seen: reference, name, ever labelled; tuned: reference. Of the open names, one of
    each tender by a seeded hash, ``most`` of each group. A name is left out if it was seen, if its
    tender was tuned on, if it is a platform's, or if it shares a long word with an earlier one of its
    tender: kept rows, then ``seq``.
    """
    shuffled = F.xxhash64("reference", "name", F.lit(seed))
    one = open_names.join(tuned.select("reference").distinct(), "reference", "left_anti")
    one = one.withColumn("_n", F.row_number().over(Window.partitionBy("group", "reference").orderBy(shuffled, "name"))).where("_n = 1")
    one = one.withColumn("_n", F.row_number().over(Window.partitionBy("group").orderBy(shuffled, "name"))).where(F.col("_n") <= most).drop("_n")
    new = found.withColumn("_o", F.lit(1)).unionByName(one.withColumn("_o", F.lit(2)))
    new = new.withColumn("_key", F.lower("name")).where(F.coalesce(F.col("name") != "", F.lit(False)) & ~platform(F.col("name")))
    new = new.join(tuned.select("reference").distinct(), "reference", "left_anti").join(seen.select("reference", F.lower("name").alias("_key")).distinct(), ["reference", "_key"], "left_anti")
    new = new.join(kept.select("reference", F.lower("name").alias("_key")).distinct(), ["reference", "_key"], "left_anti")
    row = F.struct("_o", "seq", "name", "source", _long_words(F.col("name")).alias("words"))
    held = kept.groupBy("reference").agg(F.array_distinct(F.flatten(F.collect_list(_long_words(F.col("name"))))).alias("_used"))
    per = new.groupBy("reference").agg(F.array_sort(F.collect_list(row)).alias("_rows")).join(held, "reference", "left")
    kind = per.schema["_rows"].dataType.simpleString()
    start = F.struct(F.coalesce("_used", F.array().cast("array<string>")).alias("used"), F.array().cast(kind).alias("rows"))

    def step(state: Column, r: Column) -> Column:
        fresh = ~F.arrays_overlap(state["used"], r["words"])
        return F.when(F.coalesce(fresh, F.lit(True)), F.struct(F.concat(state["used"], r["words"]).alias("used"), F.concat(state["rows"], F.array(r)).alias("rows"))).otherwise(state)

    picked = per.select("reference", F.explode(F.aggregate("_rows", start, step, lambda s: s["rows"])).alias("r")).select("reference", "r.name", F.lit("").alias("letter"), "r.source", F.lit("holdout").alias("split"))
    return kept.select("reference", "name", "letter", "source", F.lit("holdout").alias("split")).unionByName(picked)


# ---- copies of tenders ----------------------------------------------------------------------------

def phrase(style: Column, name: Column, model: Column, part: Column, part_fr: Column, equivalent: Column) -> Column:
    """The lines that put a brand into a tender, in one of seven wording styles."""
    en, fr = F.when(equivalent, " or equivalent").otherwise(""), F.when(equivalent, " ou équivalent").otherwise("")
    big = F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substring(part, F.lit(2), F.length(part))))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(style == "prose", F.array(say("The ", part, " must be a ", name, " ", model, en, "."))).when(style == "table", F.array(big, say(name, " ", model, en)))
        .when(style == "field", F.array(say(big, " - make and model: ", name, " ", model, en))).when(style == "trademark", F.array(say("The ", part, " shall be a ", name, "® ", model, en, ".")))
        .when(style == "oem", F.array(say("Only a genuine ", name, " ", model, " ", part, en, " will be accepted."))).when(style == "no_model", F.array(say("The ", part, " must be manufactured by ", name, en, ".")))
        .when(style == "french", F.array(say("Le ", part_fr, " doit être un ", name, " ", model, fr, ".")))
    )


def pick_bases(tenders: DataFrame, most: int = 40, seed: int = 7) -> DataFrame:
    """The tenders that copies are made of: closed, in the base, with observations and a requirement section; in a seeded order."""
    good = tenders.where((F.col("route") == "close") & (F.col("pile") == "base") & (F.col("observations") > 0) & F.col("has_section") & ~F.col("has_clause"))
    return good.withColumn("_h", F.xxhash64("reference", F.lit(seed))).orderBy("_h", "reference").limit(most).drop("_h")


def make_copies(bases: DataFrame, brands: DataFrame, variants: list[str] = list(VARIANTS)) -> DataFrame:
    """A copy of every base for every variant, with lines put in at two fifths of its candidate lines.

    bases: reference, lines array<string>, places array<int> (lines, from 0, after which something can
    be put in), nth (their number). brands: nth, name, model, part, part_fr, maker. Variant B has two
    brands; C's winner is the maker; D's brand accepts an equivalent; E's stands in a bidder's question;
    F has none.
    """
    n = brands.count()
    rows = bases.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants]))).withColumn("v", F.ascii("variant") - 65)
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (F.col("nth") + F.col("v")) % len(STYLES) + 1)
    rows = rows.withColumns({"style": style, "expected": _lookup(VARIANTS, F.col("variant"))})
    pick = lambda k: brands.select(F.col("nth").alias(f"_b{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("name", "model", "part", "part_fr", "maker")])
    rows = rows.withColumn("_b1", (F.col("nth") + F.col("v")) % n).withColumn("_b2", (F.col("nth") + F.col("v") + 1) % n).join(F.broadcast(pick(1)), "_b1").join(F.broadcast(pick(2)), "_b2")
    said = lambda k, equivalent: phrase(F.col("style"), *[F.col(f"{c}{k}") for c in ("name", "model", "part", "part_fr")], equivalent)
    no, first = F.lit(False), F.get("places", F.floor(F.size("places") * 2 / 5).cast("int"))
    question = F.concat(F.array(F.lit(""), F.lit("Question 1:")), said(1, no), F.array(F.lit("Answer 1: see the requirement."), F.lit("")))
    put = (
        F.when(F.col("variant") == "F", F.array().cast("array<string>")).when(F.col("variant") == "B", F.concat(said(1, no), said(2, no)))
        .when(F.col("variant") == "D", said(1, F.lit(True))).when(F.col("variant") == "E", question).otherwise(said(1, no))
    )
    at = F.coalesce(first, F.size("lines") - 1) + 1
    text = F.array_join(F.concat(F.slice("lines", F.lit(1), at), put, F.slice("lines", at + 1, F.size("lines"))), "\n")
    brands_in = F.when(F.col("variant") == "F", F.array().cast("array<string>")).when(F.col("variant") == "B", F.array("name1", "name2")).otherwise(F.array("name1"))
    return rows.select(F.concat("reference", F.lit("-"), "variant").alias("reference"), F.col("reference").alias("base"), "variant", "expected", "style", brands_in.alias("brands"), F.when(F.col("variant") == "C", F.col("maker1")).alias("winner"), (at + 1).alias("line_no"), text.alias("text"))


def expected_routes(copies: DataFrame, clauses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Copies with ``allows`` (their base accepts equivalents for every brand: by hand review, else by its clauses),
    ``rigged`` and the expected route: a brand that a clause makes legal is expected to close."""
    told = reviews.select(F.col("base"), (F.lower("allows") == "yes").alias("_hand"))
    rows = copies.join(clauses.select(F.col("reference").alias("base"), (F.col("blanket") | F.col("equivalent_products")).alias("_clause")), "base", "left").join(told, "base", "left")
    rows = rows.withColumn("allows", F.coalesce("_hand", "_clause", F.lit(False))).drop("_hand", "_clause")
    return rows.withColumn("rigged", F.col("variant").isin(*RIGGED) & ~F.col("allows")).withColumn("expected", F.when(F.col("allows"), "close").otherwise(F.col("expected")))


def brand_outcomes(copies: DataFrame, checked: DataFrame) -> DataFrame:
    """(reference, brand, outcome) for every brand put in: found, cleared_<why>, brand_not_confirmed or not_picked_up.

    checked: reference, name, result, status, as ``brands.names_checked`` returns them. A name counts
    if it begins with the brand's words; the last of several cleared ones tells why.
    """
    put = copies.select("reference", F.explode("brands").alias("brand"))
    met = put.join(checked.select(F.col("reference").alias("_r"), "name", "result", "status", "place"), (F.col("reference") == F.col("_r")) & names.begins_with(F.col("name"), F.col("brand")), "left")
    cleared = F.max_by("status", F.when(F.col("result") == "cleared", F.col("place")))
    per = met.groupBy("reference", "brand").agg(F.max(F.col("result") == "finding").alias("f"), F.max(F.col("result") == "cleared").alias("c"), F.max(F.col("result") == "open").alias("o"), cleared.alias("s"))
    outcome = F.when(F.col("f"), "found").when(F.col("c"), F.concat(F.lit("cleared_"), F.coalesce(_lookup(OUTCOME, F.col("s")), F.col("s")))).when(F.col("o"), "brand_not_confirmed").otherwise("not_picked_up")
    return per.select("reference", "brand", outcome.alias("outcome"))


def routing_report(copies: DataFrame, cases: DataFrame) -> DataFrame:
    """Copies by variant and clause: how many came to each route, and how many as expected."""
    rows = copies.join(cases.select("reference", "route"), "reference")
    return rows.groupBy("variant", "allows").agg(
        F.max("expected").alias("expected"), *[F.count_if(F.col("route") == r).alias(r) for r in ("alert", "watch", "close")], F.count_if(F.col("route") == F.col("expected")).alias("as_expected"), F.count("*").alias("copies")
    )


def outcome_report(copies: DataFrame, outcomes: DataFrame, cache: DataFrame) -> DataFrame:
    """Brands put into rigged copies, found and all, by (view, value): by outcome, wording style, and what the cache says.

    cache: key, brand.
    """
    rows = outcomes.join(copies.where("rigged").select("reference", "style"), "reference").join(cache.select(F.col("key").alias("_k"), F.col("brand").alias("_known")), F.lower("brand") == F.col("_k"), "left")
    known = F.when(F.col("_known"), "confirmed").when(~F.col("_known"), "not a brand").otherwise("unknown")
    views = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), c.alias("value")) for v, c in (("outcome", F.col("outcome")), ("style", F.col("style")), ("cache", known))])).alias("x")
    return rows.select("outcome", views).groupBy("x.view", "x.value").agg(F.count("*").alias("brands"), F.count_if(F.col("outcome") == "found").alias("found"))


def false_alarms(copies: DataFrame, findings: DataFrame) -> DataFrame:
    """Copies that should close, by variant: how many have a finding on a brand that was put in. findings: reference, name."""
    put = copies.where(~F.col("rigged") & (F.col("variant") != "F")).select("reference", "variant", F.explode("brands").alias("brand"))
    hit = put.join(findings.select(F.col("reference").alias("_r"), "name"), (F.col("reference") == F.col("_r")) & names.begins_with(F.col("name"), F.col("brand")), "left")
    per = hit.groupBy("variant", "reference").agg(F.max(F.col("name").isNotNull()).alias("flagged"))
    return per.groupBy("variant").agg(F.count("*").alias("copies"), F.count_if("flagged").alias("flagged"))


def mode_report(rows: DataFrame, modes: list[str]) -> DataFrame:
    """Per mode of M4's checks: flagged tenders, hits and false alarms, and how many differ from the first mode.

    rows: reference, lock_in, and a boolean of each mode.
    """
    told = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("flagged"), (F.col(m) != F.col(modes[0])).alias("differs")) for m in modes])).alias("x")
    return rows.select("lock_in", told).groupBy("x.mode").agg(
        F.count_if("x.flagged").alias("flagged"), F.count_if(F.col("x.flagged") & F.col("lock_in")).alias("hits"), F.count_if(F.col("x.flagged") & ~F.col("lock_in")).alias("false_alarms"), F.count_if("x.differs").alias("differs")
    )
