"""Tenders judged one after the other, each against the base as the ones before it left it.

What a tender is judged by depends on verdicts before it, but few verdicts change a base so that
another one changes. So all tenders are judged at once, against the base that results from the last
round's verdicts; those whose base has changed are judged again, until nothing changes. A round
settles at least the first tender that was judged wrongly, so the end is what a plain walk gives.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from awardgrid.operators.level2 import FLAT, LEAST_PEERS, NARROW, STRICT
from awardgrid.operators.matching import written
from awardgrid.operators.scoring import ALERT, LEVEL_TWO_CAP, POINTS, WATCH
from awardgrid.operators.stats import MAD_SCALE

#: Rows of an attribute that one task judges in their order.
STRETCH = 4096
#: Rows that one task sorts before they are cut into stretches.
SORTED = 200_000
_EVER = -(1 << 62)
_KEY = ["group", "key"]


def _events(occurrences: DataFrame, base: DataFrame | None) -> DataFrame:
    """What happens to each attribute's base, in the order (place, reference, turn, kind).

    kind 1: a tender's turn; it is judged, then joins if its ``owner`` (itself) is of the base. kind 0:
    a member leaves, at the next turn of its reference; and what earlier runs left joins, before all
    turns. Key "" holds one row for each tender, the others one for each of its attributes. Tenders are
    counted as long as their turn lasts: in key "" a member leaves after it (kind 2).
    """
    ahead = Window.partitionBy("group", "reference").orderBy("place", "t")
    turns = occurrences.withColumns({"next_place": F.lead("place").over(ahead), "next_turn": F.lead("t").over(ahead)})
    whole = F.array(F.struct(F.lit("").alias("key"), F.lit(-1).alias("idx"), F.lit(0.0).alias("value"), F.lit(None).cast("double").alias("width"), F.lit(False).alias("ge"), F.lit(False).alias("le")))
    side = lambda a, name: F.coalesce(F.array_contains(a["sides"], name), F.lit(False))
    own = lambda a, i: F.struct(F.concat(F.lit("#"), a["key"]).alias("key"), i.alias("idx"), a["value"].alias("value"), a["width"].alias("width"), side(a, "GE").alias("ge"), side(a, "LE").alias("le"))
    each = F.explode(F.concat(whole, F.coalesce(F.transform("attributes", own), F.array().cast(_attribute_kind())))).alias("a")
    told = turns.select("group", "place", "reference", "t", "next_place", "next_turn", each).select("*", "a.*").drop("a")
    judged = told.select("group", "key", "place", "reference", F.col("t").alias("turn"), F.lit(1).alias("kind"), "t", F.col("t").alias("owner"), "idx", "value", "width", "ge", "le", F.lit(False).alias("base"))
    leaves_at = F.when(F.col("key") == "", 2).otherwise(0)
    nothing = {"t": F.lit(None).cast("long"), "idx": F.lit(None).cast("int"), "width": F.lit(None).cast("double"), "ge": F.lit(False), "le": F.lit(False)}
    leaving = told.where("next_place is not null").select("group", "key", F.col("next_place").alias("place"), "reference", F.col("next_turn").alias("turn"), leaves_at.alias("kind"), F.col("t").alias("owner"), "value", F.lit(False).alias("base"))
    out = judged.unionByName(leaving.withColumns(nothing))
    if base is None:
        return out
    first = turns.groupBy("group", "reference").agg(F.min(F.struct("place", "t")).alias("first"))
    held = base.dropDuplicates(["group", "reference"]).select("group", "reference", F.explode(F.concat(whole, F.coalesce(F.transform("attributes", own), F.array().cast(_attribute_kind())))).alias("a"))
    held = held.join(first, ["group", "reference"], "left").select("group", "a.key", "reference", "first", "a.value")
    no_owner = nothing | {"owner": F.lit(None).cast("long"), "kind": F.lit(0), "base": F.lit(True)}
    joins = held.select("group", "key", F.lit(_EVER).alias("place"), "reference", F.lit(_EVER).alias("turn"), "value").withColumns(no_owner)
    leaves = held.where("first is not null").select("group", "key", "first.place", "reference", F.col("first.t").alias("turn"), "value").withColumns(no_owner | {"base": F.lit(False), "kind": leaves_at})
    return out.unionByName(joins).unionByName(leaves)


def _attribute_kind() -> str:
    return "array<struct<key:string,idx:int,value:double,width:double,ge:boolean,le:boolean>>"


def _cut(rows: DataFrame, n: int, order: list[str], name: str, stretch: int, each: int = SORTED) -> DataFrame:
    """Adds ``name``, a number that ascends in ``order``: some ``stretch`` rows share one, and equal rows always do.

    The ``n`` rows are sorted into ranges of some ``each`` and numbered where they lie, on top of the range's own number.
    So the driver samples splitters for these few ranges, not for every stretch.
    """
    least = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 10_000))
    placed = rows.repartitionByRange(max(1, least, -(-n // each)), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("_at", F.min("_at").over(Window.partitionBy(*order))).withColumn(name, F.expr(f"_at div {stretch}")).drop("_at")


def _laid_out(events: DataFrame, stretch: int) -> DataFrame:
    """Events with ``range``, the stretch of values they lie in, and ``part``, the stretch of turns.

    Stretches go over all keys, so a key of any size is cut, and small keys share a stretch. Key "" has no values.
    """
    events = written(events, "events")
    n = events.count()
    ranged = _cut(events.where("key <> ''"), n, [*_KEY, "value"], "range", stretch)
    ranged = written(ranged.unionByName(events.where("key = ''").withColumn("range", F.lit(0).cast("long"))), "ranged")
    return written(_cut(ranged, n, [*_KEY, "place", "reference", "turn", "kind"], "part", stretch), "laid")


class _Stretch:
    """The base of an attribute while turns pass: members before this stretch by ranges of values, and its own."""

    def __init__(self, ranges: np.ndarray, prior: dict[int, tuple[int, float, float]], known: dict[int, list[tuple[float, int]]]):
        self.place = {int(r): i for i, r in enumerate(ranges)} if prior else {}
        n = max(1, len(self.place))
        self.prior, self.low, self.high = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for r, (count, low, high) in prior.items():
            i = self.place[r]
            self.prior[i], self.low[i], self.high[i] = count, low, high
        self.known = {self.place[r]: values for r, values in known.items()}
        for i in np.flatnonzero((self.prior > 0) & (self.low == self.high)):
            self.known.setdefault(int(i), [(float(self.low[i]), int(self.prior[i]))])
        self.count = self.prior.copy()
        self.held: list[list[float]] = [[] for _ in range(n)]
        self.gone: list[list[float]] = [[] for _ in range(n)]
        self.needs: set[int] = set()

    def join(self, value: float, r: int) -> None:
        i = self.place.get(r, 0)
        insort(self.held[i], value)
        self.count[i] += 1

    def leave(self, value: float, r: int) -> None:
        i = self.place.get(r, 0)
        at = bisect_left(self.held[i], value)
        if at < len(self.held[i]) and self.held[i][at] == value:
            self.held[i].pop(at)
        else:
            insort(self.gone[i], value)
        self.count[i] -= 1

    def _values(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of a range with their numbers, ascending; the range must be known or without members before."""
        of: dict[float, int] = {}
        for v, c in [*self.known.get(i, ()), *((v, 1) for v in self.held[i]), *((v, -1) for v in self.gone[i])]:
            of[v] = of.get(v, 0) + c
        values = sorted(v for v, c in of.items() if c)
        return np.array(values), np.array([of[v] for v in values], np.int64)

    def at(self, k: int) -> float | None:
        """The value at place k, or None if its range must be fetched first."""
        upto = np.cumsum(self.count)
        i = int(np.searchsorted(upto, k, "right"))
        inside = k - (int(upto[i - 1]) if i else 0)
        if not self.prior[i]:
            return self.held[i][inside]
        if i not in self.known:
            self.needs.add(i)
            return None
        values, counts = self._values(i)
        return float(values[np.searchsorted(np.cumsum(counts), inside, "right")])

    def middle_distance(self, centre: float, n: int) -> float | None:
        """The median distance from ``centre``, or None if ranges must be fetched first.

        A range that isn't known lies between two distances. With all of its members at the nearer
        ends the median is too small, at the farther ones too large; only ranges that reach in between matter.
        """
        own = np.concatenate([np.array(h) for h in self.held]) if self.prior.any() else np.array(self.held[0])
        far = np.abs(own - centre)
        ks = ((n - 1) // 2, n // 2)
        if not self.prior.any():
            part = np.partition(far, ks)
            return float(part[ks[0]] if n % 2 else (part[ks[0]] + part[ks[1]]) / 2)
        weight = np.ones(len(far), np.int64)
        more, counts, hidden = [], [], []
        for i in np.flatnonzero(self.prior).tolist():
            if i in self.known:
                pairs = [*self.known[i], *((v, -1) for v in self.gone[i])]
                more += [abs(v - centre) for v, _ in pairs]
                counts += [c for _, c in pairs]
            else:
                near = max(0.0, self.low[i] - centre, centre - self.high[i])
                hidden.append((i, near, max(abs(self.low[i] - centre), abs(self.high[i] - centre)), int(self.prior[i]) - len(self.gone[i])))
        far, weight = np.concatenate([far, np.array(more)]), np.concatenate([weight, np.array(counts, np.int64)])

        def medians(ends: list[float]) -> list[float]:
            d, w = np.concatenate([far, np.array(ends)]), np.concatenate([weight, np.array([h[3] for h in hidden], np.int64)])
            d, at = np.unique(d, return_inverse=True)
            upto = np.cumsum(np.bincount(at, w, len(d)))
            return [float(d[np.searchsorted(upto, k, "right")]) for k in ks]

        small, large = medians([h[1] for h in hidden]), medians([h[2] for h in hidden])
        if small == large:
            return small[0] if n % 2 else (small[0] + small[1]) / 2
        self.needs |= {i for i, near, end, w in hidden if w and near < large[1] and end > small[0]}
        return None

    def verdict(self, value: float, width: float | None, ge: bool, le: bool) -> tuple[bool, str | None]:
        """(whether it can be told yet, what ``level2.judged`` finds for one attribute of a tender)."""
        n = int(self.count.sum())
        if n < LEAST_PEERS:
            return True, None
        if width is not None:
            ends = self.at(0), self.at(n - 1)
            if None in ends:
                return False, None
            if ends[1] > ends[0]:
                return True, "narrow_band" if width / (ends[1] - ends[0]) <= NARROW else None
        a, b = self.at((n - 1) // 2), self.at(n // 2)
        if a is None or b is None:
            return False, None
        middle = a if n % 2 else (a + b) / 2
        far = self.middle_distance(middle, n)
        if far is None:
            return False, None
        mad = MAD_SCALE * far
        if mad <= 0 or mad < FLAT * abs(middle) or not (ge or le):
            return True, None
        z = (value - middle) / mad
        return True, "extreme_threshold" if (z if ge else -z) >= STRICT else None


_JUDGED = "group string, key string, part long, t long, idx int, found string, range long"


def _judge(rows: pd.DataFrame) -> pd.DataFrame:
    """All stretches of a part: verdicts, or else the ranges that a stretch must know first."""
    out: list[tuple] = []
    for (group, key), own in rows.groupby(_KEY, sort=False):
        part = int(own["part"].iloc[0])
        prior = {int(x.range): (int(x.count_before), x.low, x.high) for x in own[own["tag"] == "prior"].itertuples()}
        known: dict[int, list[tuple[float, int]]] = {}
        for x in own[own["tag"] == "known"].itertuples():
            known.setdefault(int(x.range), []).append((x.value, int(x.count_before)))
        for x in own[own["tag"] == "asked"].itertuples():
            known.setdefault(int(x.range), [])
        turns = own[own["tag"] == "turn"].sort_values(["place", "reference", "turn", "kind"])
        base = _Stretch(np.unique(np.concatenate([turns["range"].to_numpy(np.int64), np.array(list(prior), np.int64)])), prior, {r: v for r, v in known.items() if r in prior})
        found = []
        cols = (turns[c].tolist() for c in ("kind", "t", "idx", "value", "width", "ge", "le", "sign", "range"))
        for kind, t, idx, value, width, ge, le, sign, r in zip(*cols, strict=True):
            if kind:
                _, what = base.verdict(value, None if width != width else width, ge, le)
                if what:
                    found.append((group, key, part, int(t), int(idx), what, None))
            if sign > 0:
                base.join(value, r)
            elif sign < 0:
                base.leave(value, r)
        if base.needs:
            names = {i: r for r, i in base.place.items()}
            found = [(group, key, part, None, None, None, names[i]) for i in sorted(base.needs)]
        out += found
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _JUDGED.split(", ")])
    return frame.astype({"part": "Int64", "t": "Int64", "idx": "Int32", "range": "Int64"})


def _judged_stretches(rows: DataFrame, active: DataFrame, bounds: DataFrame, several: DataFrame) -> DataFrame:
    """(group, key, part, t, idx, found) of some stretches' turns that something is found for.

    rows: the turns of the stretches; active: all turns with their sign. Stretches ask for ranges of
    values until their verdicts can be told; what they get is the numbers of those values before them.
    """
    stretches = rows.select(*_KEY, "part").distinct()
    points = active.join(several, _KEY, "left_semi").where("sign <> 0")
    counts = points.groupBy(*_KEY, "part", "range").agg(F.sum("sign").alias("c"))
    grid = active.join(several, _KEY, "left_semi").select(*_KEY, "part").distinct().join(bounds, _KEY).join(counts, [*_KEY, "part", "range"], "left")
    before = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy(*_KEY, "range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    prior = grid.withColumn("count_before", before).where("count_before <> 0").join(stretches, [*_KEY, "part"], "left_semi")
    prior = written(prior.select(*_KEY, "part", "range", "low", "high", "count_before", F.lit("prior").alias("tag")), "prior")
    turns = rows.withColumn("tag", F.lit("turn"))
    told, asked, pending = [], None, None
    while True:
        given = turns.unionByName(prior, allowMissingColumns=True)
        if asked is not None:
            known = asked.alias("q").join(points.alias("p"), [*_KEY, "range"]).where("p.part < q.part").groupBy(*_KEY, F.col("q.part").alias("part"), "range", "value").agg(F.sum("sign").alias("count_before")).where("count_before <> 0")
            given = given.unionByName(known.withColumn("tag", F.lit("known")), allowMissingColumns=True).unionByName(asked.withColumn("tag", F.lit("asked")), allowMissingColumns=True)
            given = given.join(pending, [*_KEY, "part"], "left_semi")
        out = written(given.groupBy("part").applyInPandas(_judge, _JUDGED), "judged")
        told.append(out.where("found is not null").drop("range"))
        needs = out.where("range is not null").select(*_KEY, "part", "range")
        if needs.isEmpty():
            return reduce(DataFrame.union, told)
        pending = needs.select(*_KEY, "part").distinct()
        asked = needs if asked is None else asked.join(pending, [*_KEY, "part"], "left_semi").union(needs).distinct()


def _outcome(occurrences: DataFrame, found: DataFrame | None) -> DataFrame:
    """Tenders with kinds (in the order of their attributes), score, route and pile."""
    told = occurrences.drop("attributes")
    if found is None:
        told = told.withColumn("kinds", F.array().cast("array<string>"))
    else:
        kinds = found.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "found"))), lambda x: x["found"]).alias("kinds"))
        told = told.join(kinds, "t", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    worth = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])
    points = F.aggregate(F.slice("kinds", 1, LEVEL_TWO_CAP), F.lit(0), lambda a, k: a + F.coalesce(worth[k], F.lit(0)))
    told = told.withColumn("score", (F.col("score") + points).cast("int"))
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    route = F.when(is_true("closed"), "close").when((F.col("doc_score") >= ALERT) & is_true("brand"), "alert").when((F.col("score") >= WATCH) & is_true("other"), "watch").otherwise("close")
    return told.withColumn("route", route).withColumn("pile", F.when(F.col("route") != "close", "quarantine").when(is_true("has_docs"), "base").otherwise("none"))


def _signed(laid: DataFrame, outcome: DataFrame) -> DataFrame:
    """Turns with their effect on the base: 1 where a member joins after it, -1 where one leaves, else 0."""
    member = outcome.select(F.col("t").alias("owner"), (F.col("pile") == "base").alias("member"))
    sign = F.when(F.col("base"), 1).when(F.col("owner").isNull(), -1).when(~F.col("member"), 0).when(F.col("kind") == 1, 1).otherwise(-1)
    return laid.join(member, "owner", "left").withColumn("sign", sign).drop("member")


def walk_in_order(tenders: DataFrame, base: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """(group, reference, place, peers_at_time, kinds, score, route, pile) of tenders judged in their order.

    tenders: group, reference, place (the order in a group, equal places by reference), has_docs, closed (it can't have a
    contract), doc_score, score, brand and other (what ``decide_routes`` needs of its claims that aren't
    about numbers), attributes array<struct<key, value, width, sides>>, each key once, values not null. A tender first
    leaves the base; if it closes with documents it joins it, and is a peer of all after it.
    ``peers_at_time`` counts the base when its turn comes. base: group, reference, attributes, of earlier runs.

    An attribute's turns are cut into stretches of about ``stretch`` rows. What came before a stretch is known by counts
    of ranges of values, and the few ranges that hold the middles and the ends are looked into; so
    neither a group nor an attribute is one task's work, and nothing is approximate. Rounds go on
    until no tender's pile changes; a later round judges attributes with a changed member, from that turn on.
    """
    rows = tenders.select("group", "reference", F.col("place").cast("long").alias("place"), "has_docs", "closed", "doc_score", "score", "brand", "other", "attributes", F.monotonically_increasing_id().alias("t"))
    occurrences = written(rows, "tenders")
    laid = _laid_out(_events(occurrences, base), stretch)
    attributes = laid.where("key <> ''")
    several = written(attributes.groupBy(*_KEY).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(*_KEY), "several")
    bounds = written(attributes.join(several, _KEY, "left_semi").groupBy(*_KEY, "range").agg(F.min("value").alias("low"), F.max("value").alias("high")), "bounds")
    outcome, found, changed = written(_outcome(occurrences, None), "outcome"), None, None
    while True:
        active = written(_signed(attributes, outcome), "active")
        again = active
        if changed is not None:
            since = active.join(changed.select(F.col("t").alias("owner")), "owner", "left_semi").groupBy(*_KEY).agg(F.min("part").alias("since"))
            again = active.join(since, _KEY).where("part >= since").drop("since")
            found = found.join(again.select(*_KEY, "part").distinct(), [*_KEY, "part"], "left_anti")
        new = _judged_stretches(again, active, bounds, several)
        found = written(new if found is None else found.union(new), "found")
        before, outcome = outcome, written(_outcome(occurrences, found), "outcome")
        other = before.select("t", F.col("pile").alias("was"))
        changed = written(outcome.join(other, "t").where("pile <> was and (pile = 'base' or was = 'base')").select("t"), "changed")
        if changed.isEmpty():
            break
    peers = _peers_at_time(_signed(laid.where("key = ''"), outcome))
    return outcome.join(peers, "t").select("group", "reference", F.col("place").cast("int").alias("place"), "peers_at_time", "kinds", "score", "route", "pile")


def _peers_at_time(turns: DataFrame) -> DataFrame:
    """(t, peers_at_time): members of the base before each turn; sums of stretches, then of the rows of one."""
    before: Column = F.sum("sign").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = turns.groupBy("group", "part").agg(F.sum("sign").alias("sign")).select(F.col("group").alias("_g"), F.col("part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.sum("sign").over(Window.partitionBy("group", "part").orderBy("place", "reference", "turn", "kind").rowsBetween(Window.unboundedPreceding, -1))
    rows = turns.withColumn("_here", F.coalesce(here, F.lit(0))).join(parts, F.col("group").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
    return rows.where("kind = 1").select("t", (F.col("_here") + F.col("_before")).cast("int").alias("peers_at_time"))
