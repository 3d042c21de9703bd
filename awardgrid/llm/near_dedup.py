"""Near-duplicate groups by a chosen-path similarity join over minwise tokens (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm.common import Scratch, connected_components
from awardgrid.llm.kernels import give_back, mix, shingle_sets, slices, words

#: Minwise tokens that paths choose from, in two halves, one for each branch; and those of the sketch.
TOKENS, SKETCH = 64, 128
_rng = np.random.Generator(np.random.PCG64(11))
_A = _rng.integers(0, 2**31, SKETCH, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, SKETCH, np.uint64).astype(np.uint32)
CHUNK = 200
#: Tables of up to so many rows (of ids and hashes) are broadcast after a count; longer ones are shuffled.
FEW_ROWS = 1_000_000


def minwise(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SKETCH minwise tokens of each non-empty set; of an empty one, zeros."""
    out = np.zeros((len(bounds) - 1, SKETCH), np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        x = (mix(keys) >> np.uint64(16)).astype(np.uint32)
        first = bounds[:-1][some]
        for j in range(SKETCH):
            y = x * _A[j] + _B[j]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[some, j] = np.minimum.reduceat(y, first)
    return out


def sets_of(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    out: list[np.ndarray] = []
    for _, _, data, offs in slices(texts):
        keys, bounds = shingle_sets(words(data, offs, lower=True), shingle)
        out += [keys[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def overlaps(sets: list[np.ndarray], block: int = 1 << 14) -> np.ndarray:
    """Sizes of all intersections within a small list, by products of blocks of the shared shingles."""
    size = np.array([len(s) for s in sets])
    keys, inverse, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    name = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[inverse] > 1
    row, col = row[shared], name[inverse[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int((count > 1).sum()), block):
        a, b = np.searchsorted(col, [start, start + block])
        m = np.zeros((len(sets), block), np.float32)
        m[row[a:b], col[a:b] - start] = 1
        total += m @ m.T
    total[np.arange(len(sets)), np.arange(len(sets))] = size
    return total.astype(np.int64)


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links within a small list, as (id, least id of its connected part)."""
    size = np.array([len(s) for s in sets])
    both = overlaps(sets)
    near = (100 * both >= percent * (size[:, None] + size[None] - both)) & (size > 0)[:, None] & (size > 0)[None]
    todo, out = np.ones(len(ids), bool), []
    for i in np.argsort(ids, kind="stable"):
        if not todo[i]:
            continue
        todo[i] = False
        edge = np.array([i])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(0) & todo)
            todo[edge] = False
            out += [(int(v), int(ids[i])) for v in ids[edge] if v != ids[i]]
    return out


def near_sketches(n: np.ndarray, b0: np.ndarray, b1: np.ndarray, m: np.ndarray, c0: np.ndarray, c1: np.ndarray, percent: int, least_bits: int) -> np.ndarray:
    """Which pairs (by broadcasting) have sizes and sketches that a similarity of ``percent`` allows."""
    differ = np.bitwise_count((b0 ^ c0).view(np.uint64)).astype(np.int16) + np.bitwise_count((b1 ^ c1).view(np.uint64))
    agree = SKETCH - differ
    return (agree >= least_bits) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def leaf_links(node: np.ndarray, doc: np.ndarray, n: np.ndarray, b0: np.ndarray, b1: np.ndarray, percent: int, least_bits: int, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of every node are compared; its candidates come back as stars around their least ids.

    Nodes of one size are compared together, ``cells`` pairs at a time.
    """
    order = np.lexsort((doc, node))
    node, doc, n, b0, b1 = (x[order] for x in (node, doc, n, b0, b1))
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.append(first, len(node)))
    out = []
    for k in np.unique(size[size > 1]).tolist():
        starts = first[size == k]
        step = max(1, cells // (k * k))
        for lo in range(0, len(starts), step):
            at = starts[lo : lo + step, None] + np.arange(k)
            side = lambda x: (x[at][:, :, None], x[at][:, None, :])  # noqa: B023, E731
            (n1, n2), (p1, p2), (q1, q2) = side(n), side(b0), side(b1)
            near = near_sketches(n1, p1, q1, n2, p2, q2, percent, least_bits)
            some = np.flatnonzero(near.sum((1, 2)) > k)  # each is near to itself
            if not len(some):
                continue
            near, at = near[some], at[some]
            root = np.broadcast_to(np.arange(k), at.shape)
            while True:
                new = np.where(near, root[:, None, :], k).min(2)
                new = np.take_along_axis(new, new, 1)
                if (new == root).all():
                    break
                root = new
            x, y = np.nonzero(root != np.arange(k))
            out.append((doc[at[x, root[x, y]]], doc[at[x, y]]))
    a, b = ([np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2)
    other = a != b  # an id with several texts
    return a[other], b[other]


def _child(node: Column, sig: Column, branch: int) -> Column:
    """The node below, by the minwise token that this branch of the node chooses."""
    at = F.pmod(F.xxhash64(node, F.lit(branch)), F.lit(TOKENS // 2)) + branch * (TOKENS // 2)
    return F.xxhash64(node, F.lit(branch), F.get(sig, at.cast("int")))


def _agree(a: str, b: str) -> Column:
    """Equal bits of two sketches."""
    return SKETCH - F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))) - F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1")))


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    trees: int = 4,
    leaf: int = 200,
    depth: int = 12,
    least_bits: int = 100,
    chunk: int = CHUNK,
    block: int = 4096,
    bucket_words: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: groups linked by Jaccard >= ``percent``/100.

    Documents with equal shingle sets are one from the start (the least id stands for them). Each of
    ``trees`` independent trees starts with all documents in its root. A node sends a document down
    two branches, to the child named by the minwise token that the branch chose at random; two
    documents of similarity s stay together in a branch with chance s. So a pair at 0.8 reaches a
    common leaf in one tree with a chance of at least 0.9375, whatever the depth (the fixed point of
    q = 1 - (1 - 0.8 q)**2), and in one of four with 0.99998. A node of up to ``leaf`` documents is
    compared exhaustively by sizes and 128-bit sketches, which sort out what can't be similar (at 0.8
    a pair agrees in 115 bits on average, with a deviation of 3.4).

    Larger nodes branch on while they shrink. One is *heavy*, and its documents are candidates of
    its least id, if half of them agree with that one as near-duplicates do, or at ``depth``.

    Documents that are connected by candidates form a cluster, and what is linked is settled there on
    full sets. Each text goes to its cluster once. A cluster of up to ``chunk`` documents is compared
    exhaustively. A larger one is compared in chunks of bounded size, each together with a few pivots
    of the cluster; then the sketches of every document outside its largest connected part are
    compared, in blocks, with those of the whole cluster, and documents with candidates in another
    part are compared on full sets, in blocks again. So no link between the parts of a cluster is lost and no group of any size
    meets in one task. Pairs inside a connected part need no comparison.

    A document of fewer words than ``shingle`` has its whole sequence as its one shingle. Null and
    empty texts and texts without words have none, are linked with nothing and kept. A null id is
    its own group (component_id null) and kept. Repeated rows give a row each; the same id counts as
    one document. Very long texts are read whole; chunks hold fewer of them. Only the named columns
    are read, whatever the others are called. Empty tables give no rows.
    """
    scratch = Scratch(spark, "near")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                keys, bounds = shingle_sets(words(data, offs, lower=True), shingle)
                low = minwise(keys, bounds)
                bits = np.packbits(low & 1, axis=1).view("<i8")
                n = np.diff(bounds)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(c)))]) for c in (0x5BD1E995, 0x1B873593)]
                digest = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
                tokens = low[:, :TOKENS].astype(np.uint32).view(np.int32)
                yield pa.record_batch(
                    [
                        batch.column("doc").slice(lo, hi - lo), pa.array(n.astype(np.int64)), *map(pa.array, digest), pa.array(bits[:, 0]), pa.array(bits[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * TOKENS, pa.int32()), pa.array(tokens.ravel())),
                    ],
                    ["doc", "n", "h0", "h1", "b0", "b1", "sig"],
                )
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sketched = scratch.keep(rows.mapInArrow(sketch, "doc long, n long, h0 long, h1 long, b0 long, b1 long, sig array<int>"), "sketched")
    few = lambda df, n: F.broadcast(df) if n <= FEW_ROWS else df
    linkable = sketched.where("n > 0 and doc is not null")
    equal = scratch.keep(linkable.groupBy("h0", "h1").agg(F.min("doc").alias("rep")), "equal")
    n_equal = equal.count()
    reps = linkable.join(few(equal, n_equal), ["h0", "h1"]).where("doc = rep").select("doc", "n", "b0", "b1", "sig")
    reps = scratch.keep(reps, "reps")
    n_reps = reps.count()

    below = [(t, b) for t in range(trees) for b in (0, 1)]
    level = reps.select("doc", "n", "b0", "b1", F.explode(F.array(*[_child(F.xxhash64(F.lit(t), F.lit("root")), F.col("sig"), b) for t, b in below])).alias("node"))
    leaves, heavies, n_leaves = [], [], 0
    for at in range(1, depth + 1):
        level = scratch.keep(level, f"level{at}")
        sizes = level.groupBy("node").agg(F.count("*").alias("c"), F.min("doc").alias("pivot")).where("c > 1")
        sizes = scratch.keep(sizes, f"sizes{at}", n_reps)
        small = F.col("c") <= leaf
        n_sizes, in_leaves, n_large = sizes.agg(F.count("*"), F.coalesce(F.sum(F.when(small, F.col("c"))), F.lit(0)), F.count_if(~small)).first()
        n_leaves += in_leaves
        leaves.append(level.join(few(sizes.where(small).select("node"), n_sizes), "node"))
        if not n_large:
            break
        large = sizes.where(~small).join(reps.select(F.col("doc").alias("pivot"), F.col("b0").alias("p0"), F.col("b1").alias("p1")), "pivot")
        big = scratch.keep(level.join(few(large, n_large), "node").withColumn("like", _agree("b", "p") >= least_bits), f"big{at}", n_reps)
        tight = big.groupBy("node").agg((2 * F.sum(F.col("like").cast("long")) >= F.count("*")).alias("tight"))
        if at == depth:
            tight = tight.withColumn("tight", F.lit(True))
        big = big.join(few(tight, n_large), "node")
        heavies.append(big.where("tight and doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")))
        level = big.where("not tight").select("node", "doc").join(reps, "doc").select(
            "doc", "n", "b0", "b1", F.explode(F.array(*[_child(F.col("node"), F.col("sig"), b) for b in (0, 1)])).alias("node")
        )

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def compare_leaves(table: pa.Table) -> pa.Table:
        a, b = leaf_links(*(table[c].to_numpy() for c in ("node", "doc", "n", "b0", "b1")), percent, least_bits)
        return pa.table({"a": a, "b": b})

    buckets = max(1, -(-n_leaves // 100_000))
    leaf_rows = union([p.select("node", "doc", "n", "b0", "b1") for p in leaves]).withColumn("bucket", F.pmod("node", F.lit(buckets)))
    edges = leaf_rows.groupBy("bucket").applyInArrow(compare_leaves, "a long, b long")
    edges = scratch.keep(union([edges, *heavies]), "edges")
    cluster = connected_components(scratch, edges).select(F.col("node").alias("doc"), F.col("root").alias("cluster"))
    cluster = scratch.keep(cluster.join(reps.groupBy("doc").agg(F.max("n").alias("n")), "doc"), "cluster", n_reps)
    scratch.drop_others("sketched", "equal", "reps", "cluster")

    held = cluster.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum("n") / bucket_words)).alias("chunks"))
    n_words = cluster.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-n_words // bucket_words))
    member = cluster.join(few(held, n_reps), "cluster")
    member = scratch.keep(member.withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("doc", F.lit(3)), F.col("chunks"))).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(buckets)))), "member", n_reps)
    n_members = member.count()
    large = member.where("chunks > 1")
    n_large = large.count()
    places = member.select("doc", "cluster", "chunks", "chunk")
    if n_large:
        pivots = large.withColumn("slot", F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(16))).groupBy("cluster", "slot").agg(F.min("doc").alias("doc"), F.max("chunks").alias("chunks"))
        places = places.union(pivots.select("doc", "cluster", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")))

    def compare(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["doc"].to_numpy(), table["cluster"].to_numpy()))
        ids, of = table["doc"].to_numpy()[order], table["cluster"].to_numpy()[order]
        once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])])
        ids, of, order = ids[once], of[once], order[once]
        sets = sets_of(table["text"].combine_chunks().take(pa.array(order)), shingle)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        found: list[tuple[int, int]] = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
            if hi - lo == 2:
                both = np.intersect1d(sets[lo], sets[lo + 1], assume_unique=True).size
                if both and 100 * both >= percent * (len(sets[lo]) + len(sets[lo + 1]) - both):
                    found.append((int(ids[lo]), int(ids[lo + 1])))
            elif hi - lo > 2:
                found += forest(ids[lo:hi], sets[lo:hi], percent)
        give_back()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    own = F.when(F.col("chunks") > 1, F.col("cluster")).otherwise(F.lit(None).cast("long")).alias("alone")
    texts = rows.where("text is not null").join(few(places, n_members + 16 * n_large), "doc").select("doc", "cluster", own, "chunk", "text")
    links = scratch.keep(texts.groupBy("alone", "chunk").applyInArrow(compare, "a long, b long"), "links")
    roots = scratch.keep(connected_components(scratch, links), "roots", n_reps)

    if n_large:
        part = large.join(few(roots.select(F.col("node").alias("doc"), "root"), n_reps), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        part = scratch.keep(part.join(reps.select("doc", "b0", "b1"), "doc"), "part", n_reps)
        main = part.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("parts"), F.sum("count").alias("total")).where("parts > 1")
        main = main.select("cluster", F.col("m.root").alias("main"), F.ceil((F.col("total") - F.col("m.count")) / block).alias("asking"), F.ceil(F.col("total") / block).alias("asked"))
        rest = scratch.keep(part.join(few(main, n_large), "cluster"), "rest", n_reps)
        if not rest.isEmpty():
            of = lambda salt, n: F.pmod(F.xxhash64("doc", F.lit(salt)), F.col(n))
            every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
            kept = ["doc", "cluster", "n", "b0", "b1", "root"]
            asking = rest.where("root <> main").select(*kept, of(4, "asking").alias("i"), every("asked").alias("j"), F.lit(True).alias("asks"))
            asked = rest.select(*kept, every("asking").alias("i"), of(6, "asked").alias("j"), F.lit(False).alias("asks"))

            def between(table: pa.Table) -> pa.Table:
                """The documents of two blocks that have any candidate in another connected part."""
                asks = table["asks"].to_numpy()
                one, two = ({c: table[c].to_numpy()[x] for c in ("doc", "n", "b0", "b1", "root")} for x in (asks, ~asks))
                met = np.zeros(len(two["doc"]), bool)
                found = [np.zeros(0, np.int64)]
                for lo in range(0, len(one["doc"]), 256):
                    x = {c: v[lo : lo + 256, None] for c, v in one.items()}
                    near = near_sketches(x["n"], x["b0"], x["b1"], two["n"], two["b0"], two["b1"], percent, least_bits) & (x["root"] != two["root"])
                    found.append(x["doc"][near.any(1), 0])
                    met |= near.any(0)
                asking = np.concatenate(found)
                return pa.table({"doc": np.concatenate([asking, two["doc"][met]]), "asks": np.concatenate([np.ones(len(asking), bool), np.zeros(met.sum(), bool)])})

            live = scratch.keep(asking.union(asked).groupBy("cluster", "i", "j").applyInArrow(between, "doc long, asks boolean").distinct(), "live", 2 * n_reps)
            n_live = live.count()
            if n_live:
                # those are compared on full sets, in blocks of half a chunk
                half = chunk // 2
                held = rest.select("doc", "cluster", "n", "root").join(few(live, n_live), "doc")
                parts = held.groupBy("cluster").agg(*[F.greatest(F.lit(1), F.ceil(F.greatest(F.count_if(w) / half, 2 * F.sum(F.when(w, F.col("n")).otherwise(0)) / bucket_words))).alias(k) for k, w in (("asking", F.col("asks")), ("asked", ~F.col("asks")))])
                held = held.join(few(parts, n_large), "cluster")
                kept = ["doc", "root", "cluster"]
                sides = [held.where("asks").select(*kept, of(4, "asking").alias("i"), every("asked").alias("j"), "asks"), held.where("not asks").select(*kept, every("asking").alias("i"), of(6, "asked").alias("j"), "asks")]
                told = scratch.keep(rows.where("text is not null").join(few(live.select("doc").distinct(), n_live), "doc", "left_semi").dropDuplicates(["doc"]), "told")

                def across(table: pa.Table) -> pa.Table:
                    """Links between the connected parts of two blocks, no more than connect them."""
                    ids, asks, root = (table[c].to_numpy() for c in ("doc", "asks", "root"))
                    sets = sets_of(table["text"].combine_chunks(), shingle)
                    size, both = np.array([len(x) for x in sets]), overlaps(sets)
                    near = (100 * both >= percent * (size[:, None] + size[None] - both)) & (both > 0) & asks[:, None] & ~asks[None] & (root[:, None] != root[None])
                    part = {int(r): int(r) for r in root}

                    def top(x: int) -> int:
                        while part[x] != x:
                            x = part[x]
                        return x

                    found = []
                    for i, j in zip(*np.nonzero(near), strict=True):
                        x, y = top(int(root[i])), top(int(root[j]))
                        if x != y:
                            part[max(x, y)] = min(x, y)
                            found.append((int(ids[i]), int(ids[j])))
                    give_back()
                    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

                more = sides[0].union(sides[1]).join(told, "doc").groupBy("cluster", "i", "j").applyInArrow(across, "a long, b long")
                known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                roots = scratch.keep(connected_components(scratch, scratch.keep(more.union(known), "links2")), "roots2", n_reps)
    scratch.drop_others("sketched", "equal", "roots", "roots2")

    out = sketched.select("doc", "n", "h0", "h1").join(few(equal, n_equal), ["h0", "h1"], "left")
    out = out.withColumn("rep", F.when(F.col("n") > 0, F.col("rep"))).withColumn("rep", F.coalesce("rep", "doc"))
    out = out.join(few(roots.withColumnRenamed("node", "rep"), n_members), "rep", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("root", "rep"))
    return out.select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept")
    )
