"""Tenders in order by speculative rounds against a plain walk, with attributes cut into tiny stretches."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from awardgrid.operators import incremental

TENDERS = "group string, reference string, place int, has_docs boolean, closed boolean, doc_score int, score int, brand boolean, other boolean, attributes array<struct<key:string,value:double,width:double,sides:array<string>>>"
BASE = "group string, reference string, attributes array<struct<key:string,value:double,width:double,sides:array<string>>>"


def plain_verdict(value, width, sides, others):
    if len(others) < 8:
        return None
    spread = max(others) - min(others)
    if width is not None and spread > 0:
        return "narrow_band" if width / spread <= 0.25 else None
    middle = statistics.median(others)
    mad = 1.4826 * statistics.median(abs(v - middle) for v in others)
    if mad <= 0 or mad < 0.05 * abs(middle) or not sides & {"GE", "LE"}:
        return None
    z = (value - middle) / mad
    return "extreme_threshold" if (z if "GE" in sides else -z) >= 3 else None


def plain_walk(tenders, base=()):
    """One tender after the other; a member's attributes are replaced as a whole at its next turn."""
    held = {}
    for group, ref, attributes in base:
        held[group, ref] = {a[0]: a[1] for a in attributes}
    out = []
    for group, ref, place, has, closed, doc, score, brand, other, attributes in sorted(tenders, key=lambda x: (x[2], x[1])):
        peers = sum(g == group for g, _ in held)
        held.pop((group, ref), None)
        inside = [v for (g, _), v in held.items() if g == group]
        kinds = [k for a in attributes or () if (k := plain_verdict(a[1], a[2], set(a[3]), [v[a[0]] for v in inside if a[0] in v]))]
        points = score + min(2, len(kinds))
        route = "close" if closed else "alert" if doc >= 5 and brand else "watch" if points >= 2 and other else "close"
        pile = "quarantine" if route != "close" else "base" if has else "none"
        out.append((group, ref, place, peers, tuple(kinds), points, route, pile))
        if pile == "base":
            held[group, ref] = {a[0]: a[1] for a in attributes or ()}
    return out


def made(seed, n, repeated=0.0):
    r = random.Random(seed)
    rows, places = [], list(range(n))
    r.shuffle(places)
    for i in range(n):
        group, ref = r.choice("gggh"), f"t{r.randrange(n) if r.random() < repeated else n + i}"
        attributes = []
        for key in ("hot", "gaps", "few", "same"):
            if r.random() < {"hot": 0.95, "gaps": 0.7, "few": 0.1, "same": 0.4}[key]:
                v = {"hot": r.gauss(10, 2), "gaps": r.choice([1.0, 2.0, 500.0, 501.0, 1000.0]) + r.choice([0, 0.5]), "few": 3.0, "same": r.choice([7.0, 7.0, 9.0])}[key]
                v = v * 4 if r.random() < 0.1 else v
                attributes.append((key, v, r.choice([None, None, 0.5, 40.0]), sorted(r.sample(["GE", "LE", "EQ"], r.randint(0, 2)))))
        rows.append((group, ref, places[i], r.random() < 0.9, r.random() < 0.05, r.choice([0, 6]), r.choice([0, 1, 1]), r.random() < 0.1, r.random() < 0.8, attributes))
    return rows


def walked(df):
    return sorted((x.group, x.reference, x.place, x.peers_at_time, tuple(x.kinds), x.score, x.route, x.pile) for x in df.collect())


@pytest.mark.parametrize("seed,n,stretch", [(1, 150, 4096), (2, 220, 40), (3, 120, 9)])
def test_rounds_equal_the_walk(spark, seed, n, stretch):
    tenders = made(seed, n)
    want = plain_walk(tenders)
    assert len({k for x in want for k in x[4]}) == 2 and {x[7] for x in want} == {"base", "quarantine", "none"}
    got = walked(incremental.walk_in_order(spark.createDataFrame(tenders, TENDERS).repartition(5), stretch=stretch))
    assert got == sorted(want)


def test_references_that_come_again_and_an_earlier_base(spark):
    tenders = made(5, 120, repeated=0.4)
    r = random.Random(9)
    base = [(g, f"t{i}", [("hot", r.gauss(10, 2), None, ["GE"]), ("gaps", r.choice([1.0, 500.0]), None, [])]) for g in "gh" for i in range(0, 240, 6)]
    want = plain_walk(tenders, base)
    assert {x[1] for x in want} & {b[1] for b in base}
    got = walked(incremental.walk_in_order(spark.createDataFrame(tenders, TENDERS), spark.createDataFrame(base, BASE), stretch=25))
    assert got == sorted(want)


def test_nothing_and_no_attributes(spark):
    assert walked(incremental.walk_in_order(spark.createDataFrame([], TENDERS))) == []
    rows = [("g", "a", 1, True, False, 0, 0, False, False, None), ("g", "b", 2, True, False, 0, 0, False, False, [])]
    assert [x[3] for x in walked(incremental.walk_in_order(spark.createDataFrame(rows, TENDERS)))] == [0, 1]


def test_stretch_with_members_before():
    """Medians and deviations from ranges, known and not, against lists."""
    r = random.Random(4)
    for trial in range(60):
        prior = sorted(r.choice([r.gauss(0, 5), float(r.randint(-3, 3)), 1000.0]) for _ in range(r.randint(1, 60)))
        size = r.choice([3, 8])
        ranges: dict[int, list[float]] = {}
        for i, v in enumerate(prior):
            ranges.setdefault(next((k for k, own in ranges.items() if own[-1] == v), i // size), []).append(v)
        told = {k: (len(v), v[0], v[-1]) for k, v in ranges.items()}
        known: dict[int, list] = {}
        for _ in range(10):
            base = incremental._Stretch(np_unique(ranges), told, known)
            members, n_needs = list(prior), 0
            rr = random.Random(trial)
            for _ in range(25):
                k = rr.choice(sorted(ranges))
                if rr.random() < 0.4 and (inside := [v for v in members if v in ranges[k]]):
                    v = rr.choice(inside)
                    members.remove(v)
                    base.leave(v, k)
                else:
                    v = rr.choice([ranges[k][0], ranges[k][-1]])
                    members.append(v)
                    base.join(v, k)
                if len(members) < 8:
                    continue
                value, width = rr.gauss(0, 30), rr.choice([None, 0.3, 9.0])
                ready, what = base.verdict(value, width, True, False)
                if ready:
                    assert what == plain_verdict(value, width, {"GE"}, members)
                else:
                    n_needs += 1
            if not base.needs:
                break
            names = {i: k for k, i in base.place.items()}
            for i in base.needs:
                known[names[i]] = [(v, ranges[names[i]].count(v)) for v in sorted(set(ranges[names[i]]))]
        assert not n_needs


def np_unique(ranges):
    import numpy as np

    return np.array(sorted(ranges))


def test_stretches_ascend_and_keep_equal_rows_together(spark):
    """Rows are cut into many stretches by a few sorted ranges: as few splitters for the driver to sample."""
    r = random.Random(7)
    rows = [("g", r.choice("ab"), r.choice([0.0, -0.0, 5.0, r.gauss(0, 50)])) for _ in range(2000)]
    cut = incremental._cut(spark.createDataFrame(rows, "group string, key string, value double").repartition(3), 2000, ["group", "key", "value"], "range", 20, each=500)
    assert "rangepartitioning" in (plan := cut._jdf.queryExecution().executedPlan().toString()) and ", 4), REPARTITION_BY_NUM" in plan
    got = sorted(((x.key, x.value, x.range) for x in cut.collect()), key=lambda x: (x[0], x[1]))
    assert sorted((k, v) for k, v, _ in got) == sorted((k, v) for _, k, v in rows)
    assert [x[2] for x in got] == sorted(x[2] for x in got) and len({x[2] for x in got}) > 20
    assert len({(k, v) for k, v, _ in got}) == len({(k, v, c) for k, v, c in got})


def test_the_driver_samples_few_splitters(spark, monkeypatch):
    """Laid out in stretches of 4 rows, events are dealt to no more ranges than their number asks for."""
    asked = []
    deal = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda df, n, *on: asked.append(n) or deal(df, n, *on))
    occurrences = spark.createDataFrame(made(3, 120), TENDERS).selectExpr("*", "monotonically_increasing_id() as t").withColumn("place", F.col("place").cast("long"))
    laid = incremental._laid_out(incremental._events(occurrences, None), 4)
    assert asked and max(asked) <= 4
    assert laid.select("part").distinct().count() > 60 and laid.where("key <> ''").select("range").distinct().count() > 20
