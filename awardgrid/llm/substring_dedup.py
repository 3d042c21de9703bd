"""Removal of byte strings that an earlier document has, by suffix arrays (operator 4).

All occurrences of a string of L bytes must meet in one shard before a suffix array can tell which
documents share it. Shards are therefore not runs of documents but ranges of *anchors*: in every
L-byte window the K-byte string with the least hash is the anchor (a local synchronising choice, as
in sparse suffix sorting), so equal windows have equal anchors. An anchor that only one document has
can't lie in a shared string. For the others, the bytes that windows around the anchor can cover (2L-K
at most) go to the anchor's shard, where a suffix array sorts the windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm.common import Scratch
from awardgrid.llm.kernels import _BYTE, give_back, mix, powers, slices

ANCHOR = 24
SLICE = 1 << 18
_LOW20 = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, offs: np.ndarray, length: int, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of the anchors of all windows of ``length`` bytes inside one text, and
    the hashes of the bytes that those windows can cover."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    g = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])
    least = (g & ~_LOW20) | (np.arange(len(g), dtype=np.uint64) & _LOW20)
    span, w = 1, length - k + 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    change = np.zeros(len(least) + 1, np.int64)
    size = np.diff(offs)
    long = size >= length
    np.add.at(change, offs[:-1][long], 1)
    np.add.at(change, offs[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    own = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    at, own = at[new], own[new]
    pos = at + ((own.astype(np.int64) - at) & ((1 << 20) - 1))
    pos = np.unique(pos)
    own = np.searchsorted(offs, pos, "right") - 1
    begin, end = np.maximum(pos + k - length, offs[own]), np.minimum(pos + length, offs[own + 1])
    return g[pos], pos, mix((total[end] - total[begin]) * down[begin])


def _least_documents(h: np.ndarray, doc: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with their least document and whether any other has them."""
    if not len(h):
        return h, doc, np.zeros(0, bool)
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    low = np.minimum.reduceat(doc, first)
    others = np.maximum.reduceat(doc, first) > low
    if more is not None:
        others |= np.logical_or.reduceat(more[order], first)
    return h[first], low, others


def bloom_filter(spark: SparkSession, keys: DataFrame, n: int, most: int):
    """The 64-bit keys ``h`` as a broadcast bit table; each task looks bits up by ``passes``.

    The table has about two bytes a key for up to ``most`` keys and doesn't grow beyond: more keys let more others pass, none is missed.
    """
    slots = 1 << max(12, (16 * min(n, most)).bit_length() - 1)
    words = keys.select(F.shiftright(F.col("h").bitwiseAND(slots - 1), 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(slots >> 6, np.uint64)
    table[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def passes(bits, h: np.ndarray) -> np.ndarray:
    """Which hashes may be among a filter's keys."""
    slot = h & np.uint64(64 * len(bits.value) - 1)
    return (bits.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def suffix_array(text: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their next ``depth`` bytes, and the rank of each position.

    Larsson-Sadakane refinement: positions are ranked by eight bytes, and each turn sorts only the
    groups that are still tied, by the rank of what lies as far on as the depth reached, which
    doubles the depth. ``stop[i]`` is the end of the piece that position i lies in; beyond it there
    is nothing, which sorts first. What is tied to the end stays in text order, so with a depth of a
    piece's length the order is one that Kasai's bound holds for.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    room = stop - np.arange(n)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(room > j, padded[j : n + j], 0)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    reach = 8
    while reach < depth:
        tied = ~(new & np.concatenate([new[1:], [True]]))
        slot = np.flatnonzero(tied)
        if not len(slot):
            break
        at = order[slot]
        beyond = np.where(room[at] > reach, rank[np.minimum(at + reach, n - 1)] + 1, 0)
        both = (rank[at].astype(np.uint64) << np.uint64(32)) | beyond.astype(np.uint64)
        turn = np.argsort(both)
        at, both = at[turn], both[turn]
        order[slot] = at
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        new[slot] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slot, 0))
        reach *= 2
    slot = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    if len(slot):
        at = order[slot]
        order[slot] = at[np.argsort((rank[at].astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64))]
    return order, rank


LANE = 32


def common_prefixes(text: np.ndarray, stop: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place in the order, the common prefix with the place before, at most ``most``.

    Kasai's algorithm: positions are taken in text order, each against the one sorted just before it,
    and a position's prefix is at least its left neighbour's less one, so comparing goes on from
    there. The text is cut into lanes of ``LANE`` positions that advance together, eight bytes at a
    time; only a lane's first position, or a piece's, begins at nothing.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(most + 16, np.uint64)])
    word = np.zeros(n + most + 8, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : n + most + 8 + j]
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    room = np.minimum(stop - np.arange(n), np.where(before >= 0, (stop - np.arange(n))[before], 0))
    room = np.minimum(room, most)
    opens = np.ones(n, bool)
    opens[1:] = stop[1:] != stop[:-1]
    common = np.zeros(n, np.int64)
    for lane in range(LANE):
        at = np.arange(lane, n, LANE)
        low = np.where(opens[at], 0, np.maximum(common[at - 1] - 1, 0)) if lane else np.zeros(len(at), np.int64)
        low = np.minimum(low, room[at])
        live = np.flatnonzero(low < room[at])
        i, h = at[live], low[live]
        while len(i):
            diff = word[i + h] ^ word[before[i] + h]
            # the number of leading zero bytes of the difference; eight if there is none
            same = np.full(len(i), 8)
            some = np.flatnonzero(diff)
            top = diff[some] >> np.uint64(32)
            bits = np.frexp(np.where(top > 0, top, diff[some]).astype(np.float64))[1] + np.where(top > 0, 32, 0)
            same[some] = (64 - bits) // 8
            h = h + same
            on = (same == 8) & (h < room[i])
            low[live[~on]] = h[~on]
            live, i, h = live[on], i[on], h[on]
        common[at] = np.minimum(low, room[at])
    return common[order]


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted tables (strings, least owner) as one: binary search finds where b's strings stand in a."""
    (s, o), (t, p) = a, b
    at = np.searchsorted(s, t)
    found = np.zeros(len(t), bool)
    inside = at < len(s)
    found[inside] = s[at[inside]] == t[inside]
    o = o.copy()
    o[at[found]] = np.minimum(o[at[found]], p[found])
    return np.insert(s, at[~found], t[~found]), np.insert(o, at[~found], p[~found])


def shard_owners(pieces: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """One shard: for each window of ``length`` bytes its piece, its offset there, its place among the
    shard's distinct windows; and those as a sorted table with the least owner of each."""
    size = np.array([len(p) for p in pieces], np.int64)
    end = np.cumsum(size)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    piece = np.repeat(np.arange(len(pieces)), size)
    stop = end[piece]
    order, _ = suffix_array(text, stop, int(size.max(initial=0)))
    common = common_prefixes(text, stop, order, length)
    whole = stop[order] - order >= length
    # a short suffix sorts before the windows that it begins, never between equal ones
    at = order[whole]
    new = common[whole] < length
    if len(new):
        new[0] = True
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(owners[piece[at]], first) if len(first) else np.zeros(0, np.int64)
    strings = np.lib.stride_tricks.sliding_window_view(text, length)[at[first]] if len(first) else np.zeros((0, length), np.uint8)
    table = np.ascontiguousarray(strings).view(f"V{length}").ravel() if len(first) else np.zeros(0, f"V{length}")
    return piece[at], at - (end - size)[piece[at]], group, (table, least)


def owned_windows(pieces: list[bytes], owners: np.ndarray, length: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, least owner) of all windows; pieces are dealt to shards of bounded size, whose
    sorted tables are merged by binary search, so that each shard learns the owners in all others."""
    size = np.cumsum([0, *map(len, pieces)])
    cuts = [0]
    while cuts[-1] < len(pieces):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(size, size[cuts[-1]] + shard_bytes, "right")) - 1))
    shards = [shard_owners(pieces[a:b], owners[a:b], length) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if len(shards) == 1:
        p, o, g, (_, least) = shards[0]
        return p, o, least[g]
    keyed = []
    for _, _, _, (table, least) in shards:
        keyed.append((np.array([bytes(v) for v in table], dtype=object), least))
    tree = list(keyed)
    while len(tree) > 1:
        tree = [merge(tree[i], tree[i + 1]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
    strings, least = tree[0]
    out = [(p + a, o, least[np.searchsorted(strings, own[0])][g]) for (p, o, g, _), own, a in zip(shards, keyed, cuts[:-1], strict=True)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = 1 << 20,
    hot_pieces: int = 50_000,
    filter_keys: int = 64_000_000,
    part_bytes: int = 16 << 20,
    hot_windows: int = 5_000,
    with_spans: bool = True,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row.

    Every byte is removed that a string of ``length`` bytes covers which also starts in a document
    with a smaller id, as the input has it; ``spans`` lists the removed runs (start, end) in bytes.

    1. The anchors of all documents are dealt by their hashes, packed, the same ones of a few slices
       as one. Those of two documents or more are *shared*. A part is the anchors of about
       ``part_bytes`` of text.
    2. A second scan keeps the texts with shared anchors; the rest is settled there. Shared hashes
       are looked up in a Bloom filter (broadcast, some two bytes a key; its size stays that of
       ``filter_keys`` where there are more), and by the exact join that follows in any case.
    3. An anchor with the same bytes around it everywhere needs no sorting: all documents but the
       least lose those bytes. The others' bytes go to their shard (see ``shard_owners``), equal
       pieces once. An anchor of over ``hot_pieces`` pieces has no shard: documents lose a piece as a
       whole that an earlier one has, and what is left of its windows is spread over all tasks by
       their own bytes, with their owners' minimum taken before the shuffle, and joined back; pieces
       and strings that occur over ``hot_windows`` times, of which there can't be many, by a broadcast
       that is counted first.
    4. Covered windows come back by document and are united there.

    Null text counts as empty. Null ids are left alone: they neither lose bytes nor own strings.
    Rows with the same id don't take strings from each other. Repeated rows give equal rows. Texts of
    any length are read whole, slice by slice of at least one text. Empty tables give no rows. Other
    columns are ignored, whatever their names. ``with_spans`` False leaves the spans out.
    """
    scratch = Scratch(spark, "substrings")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(4, (total // part_bytes).bit_length())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part of the hashes, the anchors of some slices: hashes, their least documents, whether there are others."""

        def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, low, more = _least_documents(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cut = np.searchsorted(h, np.arange(1, parts, dtype=np.uint64) << np.uint64(65 - parts.bit_length()))
            cut = np.concatenate([[0], cut, [len(h)]])
            some = np.flatnonzero(np.diff(cut))
            take = lambda v: pa.array([v[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())
            return pa.record_batch([pa.array(some.astype(np.int32)), take(h), take(low), take(more)], ["part", "h", "low", "more"])

        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for lo, hi, data, offs in slices(batch.column("text"), SLICE):
                h, pos, _ = anchors(data, offs, length)
                held.append((h, ids[lo:hi][np.searchsorted(offs, pos, "right") - 1]))
                size += len(h)
                if size > 1 << 18:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)
        give_back()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of one part that several documents have."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, last = 0, 0
        for batch in batches:
            for h, low, more in zip(*(batch.column(c) for c in ("h", "low", "more")), strict=True):
                held.append((np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(low.as_buffer(), np.int64), np.frombuffer(more.as_buffer(), bool)))
                size += len(held[-1][0])
            if size > 2 * last + (1 << 20):  # what many slices share is merged on the way
                held = [_least_documents(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = last = len(held[0][0])
        h, _, more = _least_documents(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.record_batch([pa.array(h[more].view(np.int64))], ["h"])
        give_back()

    found = rows.where("doc is not null").mapInArrow(find, "part int, h binary, low binary, more binary")
    shared = scratch.keep(found.groupBy("part").applyInArrow(together, "h long"), "shared")
    keys = shared.count()
    bits = bloom_filter(spark, shared, keys, filter_keys)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc")
            for lo, hi, data, offs in slices(batch.column("text"), SLICE):
                h, pos, piece = anchors(data, offs, length)
                own = np.searchsorted(offs, pos, "right") - 1
                some = passes(bits, h) & ids.slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)[own]
                h, pos, piece, own = h[some], pos[some], piece[some], own[some]
                cut = np.searchsorted(own, np.arange(hi - lo + 1))
                texts = [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
                held = [t if cut[i + 1] > cut[i] else None for i, t in enumerate(texts)]
                lists = lambda v: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v))  # noqa: B023, E731
                yield pa.record_batch(
                    [
                        ids.slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(held, pa.binary()),
                        lists(h.view(np.int64)), lists((pos - offs[own]).astype(np.int32)), lists(piece.view(np.int64)),
                    ],
                    ["doc", "n_bytes", "sha", "raw", "hs", "ps", "ds"],
                )
        give_back()

    looked = rows.mapInArrow(look, "doc long, n_bytes long, sha string, raw binary, hs array<long>, ps array<int>, ds array<long>")
    looked = scratch.keep(looked.withColumn("uid", F.monotonically_increasing_id()), "looked")
    scratch.drop("shared")
    near = looked.where("raw is not null")
    lists = near.select("doc", "uid", "n_bytes", F.explode(F.arrays_zip("hs", "ps", "ds")).alias("a"))
    kinds = lists.select(F.col("a.hs").alias("h"), F.col("a.ds").alias("d"), "doc").groupBy("h").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), (F.min("d") != F.max("d")).alias("mixed"), F.count("*").alias("n")
    )
    kinds = scratch.keep(kinds.where("low < high").select("h", "low", "mixed", "n"), "kinds")
    mixed = kinds.where("mixed").select("h", "n")
    some, pieces = mixed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    begin = F.greatest(F.col("a.ps") + (ANCHOR - length), F.lit(0))
    placed = lists.select(F.col("a.hs").alias("h"), "doc", "uid", begin.alias("s"), F.least(F.col("a.ps") + length, "n_bytes").cast("int").alias("e"))
    same = placed.join(kinds.where("not mixed").select("h", "low"), "h").where("doc > low").select("uid", "s", "e")
    mixed_bits = bloom_filter(spark, mixed, some, filter_keys)

    def around_mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                out: list[tuple] = []
                for i, (raw, hs, ps) in enumerate(zip(part.column("raw"), part.column("hs"), part.column("ps"), strict=True)):
                    h, p = hs.values.to_numpy(), ps.values.to_numpy()
                    text = raw.as_buffer().to_pybytes()
                    for k in np.flatnonzero(passes(mixed_bits, h.view(np.uint64))).tolist():
                        start = max(0, int(p[k]) + ANCHOR - length)
                        out.append((i, h[k], start, text[start : p[k] + length]))
                at, h, start, piece = list(zip(*out, strict=True)) or [[]] * 4
                at = pa.array(list(at), pa.int64())
                yield pa.record_batch(
                    [pa.array(list(h), pa.int64()), part.column("doc").take(at), part.column("uid").take(at), pa.array(list(start), pa.int32()), pa.array(list(piece), pa.binary())],
                    ["h", "doc", "uid", "start", "piece"],
                )

    around = near.select("doc", "uid", "raw", "hs", "ps").mapInArrow(around_mixed, "h long, doc long, uid long, start int, piece binary")
    if some > filter_keys:
        around = around.join(mixed.select("h"), "h", "left_semi")
    hot = scratch.keep(mixed.where(F.col("n") > hot_pieces).select("h"), "hot", some)
    # half a shard each, so that only buckets with a frequent anchor have several, whose tables must be merged
    buckets = max(1, -(-2 * pieces * (2 * length - ANCHOR) // shard_bytes))

    def judge(table: pa.Table) -> pa.Table:
        code = pc.dictionary_encode(table["piece"].combine_chunks())
        which = code.indices.to_numpy()
        pieces = code.dictionary.to_pylist()
        doc, start = table["doc"].to_numpy(), table["start"].to_numpy().astype(np.int64)
        owners = np.full(len(pieces), np.iinfo(np.int64).max)
        np.minimum.at(owners, which, doc)
        # a document that isn't the piece's least owner loses the whole piece; the least one, the windows others own
        size = np.array([len(p) for p in pieces], np.int64)[which]
        later = doc > owners[which]
        p, o, least = owned_windows(pieces, owners, length, shard_bytes)
        lost = least < owners[p]
        runs = np.unique(p[lost] * (2 * length) + o[lost])
        p, o = runs // (2 * length), runs % (2 * length)
        opens = np.ones(len(runs), bool)
        opens[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1)
        ends = np.concatenate([opens[1:], [True]]) if len(runs) else opens
        rp, rs, re = p[opens], o[opens], o[ends] + length
        first = np.flatnonzero(~later)
        lo, hi = np.searchsorted(rp, which[first]), np.searchsorted(rp, which[first], "right")
        member = np.repeat(first, hi - lo)
        run = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True) if b > a] or [np.zeros(0, np.int64)]).astype(np.int64)
        at = np.concatenate([np.flatnonzero(later), member])
        begin = np.concatenate([start[later], start[member] + rs[run]])
        end = np.concatenate([(start + size)[later], start[member] + re[run]])
        return pa.table({"uid": table["uid"].to_numpy()[at], "s": begin.astype(np.int32), "e": end.astype(np.int32)})

    def owned(rows: DataFrame, name: str, keep_all: bool = False) -> DataFrame:
        """Rows with the least document of their string; without ``keep_all``, those that two documents or more have."""
        least = rows.groupBy("string").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n"))
        least = scratch.keep((least if keep_all else least.where("least < most")).select("string", "least", "n"), name)
        many = least.where(F.col("n") > hot_windows).select("string", "least")
        rest = least.where(F.col("n") <= hot_windows).select("string", "least")
        if not 0 < many.count() <= 1_000_000:
            return rows.join(least.select("string", "least"), "string")
        cool = rows.join(F.broadcast(many.select("string")), "string", "left_anti")
        return rows.join(F.broadcast(many), "string").unionByName(cool.join(rest, "string"))

    cold = around if hot.isEmpty() else around.join(F.broadcast(hot) if hot.count() <= 1_000_000 else hot, "h", "left_anti")
    cold = cold.where(F.octet_length("piece") >= length)
    lost = cold.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets))).groupBy("bucket").applyInArrow(judge, "uid long, s int, e int")
    if not hot.isEmpty():
        held = around.join(F.broadcast(hot) if hot.count() <= 1_000_000 else hot, "h", "left_semi").where(F.octet_length("piece") >= length)
        # written before each is read several times: pieces are cut out of texts once
        held = scratch.keep(held.select("doc", "uid", F.col("start").alias("s"), F.col("piece").alias("string")), "hot_pieces")
        held = scratch.keep(owned(held, "pieces", keep_all=True), "hot_owned")
        scratch.drop("hot_pieces")
        lost = lost.union(held.where("doc > least").select("uid", "s", (F.col("s") + F.octet_length("string")).cast("int")))
        windows = held.where("doc = least").withColumn("o", F.explode(F.sequence(F.lit(0), F.octet_length("string") - length)))
        windows = windows.select("doc", "uid", (F.col("s") + F.col("o")).alias("s"), F.expr(f"substring(string, o + 1, {length})").alias("string"))
        lost = lost.union(owned(windows, "windows").where("doc > least").select("uid", "s", (F.col("s") + length).cast("int")))
    lost = scratch.keep(lost, "lost_mixed").union(scratch.keep(same, "lost_same"))
    scratch.drop_others("looked", "lost_mixed", "lost_same")
    spans = lost.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("lost"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, sha, lost in zip(batch.column("raw"), batch.column("sha").to_pylist(), batch.column("lost"), strict=True):
                runs: list[list[int]] = []
                if lost.is_valid:
                    inner = lost.values
                    s, e = inner.field(0).to_numpy(), inner.field(1).to_numpy()
                    by = np.argsort(s, kind="stable")
                    s, e = s[by], np.maximum.accumulate(e[by])
                    opens = np.concatenate([[True], s[1:] > e[:-1]])
                    runs = np.stack([s[opens], e[np.concatenate([opens[1:], [True]])]], 1).tolist()
                if runs:
                    data, kept, upto = raw.as_buffer().to_pybytes(), [], 0
                    for a, b in runs:
                        kept.append(data[upto:a])
                        upto = b
                    sha = hashlib.sha256(b"".join([*kept, data[upto:]])).hexdigest()
                out.append((sum(b - a for a, b in runs), len(runs), sha, runs))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())))[: 3 + with_spans]
            yield pa.record_batch(
                [batch.column("doc"), batch.column("n_bytes"), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=False)]],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"][: 5 + with_spans],
            )

    judged = near.join(spans, "uid", "left").select("doc", "n_bytes", "sha", "raw", "lost").mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<int>>" * with_spans)
    clean = looked.where("raw is null").select(
        "doc", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), *[F.array().cast("array<array<int>>").alias("spans")] * with_spans
    )
    return judged.union(clean).withColumnRenamed("doc", id_col)
