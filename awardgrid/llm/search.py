"""Ranked lexical search with a bit-sliced impact index (operator 12)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from awardgrid.llm.common import Scratch, bound_batches

#: Bytes that terms don't hold: ASCII other than digits and letters.
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Documents of a segment, on average; a bitmap of a segment has a bit for each of them.
SEGMENT = 4096
#: Terms that one index is made for, and terms of the items that are searched in one pass over it.
TERMS_OF_INDEX, TERMS_OF_PASS = 1_000_000, 10_000
ITEMS_AT_ONCE = 32
_WEIGHT, _SCALE, _ONE, _BASE, _LENGTH = 1000, 1_000_000_000, 1000, 75, 25


@dataclass
class Index:
    """Bit-sliced impacts of some terms in all documents.

    ``slices``: (segment, term, at, bits, ids); term is a place in ``terms`` (64-bit hashes, ascending), ``bits`` its impact
    bits from the lowest, each as the 64-bit words of a bitmap at the word places ``at`` (others are
    zero); term -1 has the documents' ids, one for each place in the bitmaps.
    ``weights``: of the terms; ``documents``, ``words``: documents with a term, and all their terms.
    """

    slices: DataFrame
    terms: np.ndarray
    weights: np.ndarray
    documents: int
    words: int


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(row, item, codes, times): the distinct terms of each item, as hashes, and how often each occurs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from awardgrid.llm.kernels import slices, words

        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                w = words(data, offs, True, NOT_TERM)
                own = [np.unique(w.hash[a:b].view(np.int64), return_counts=True) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.record_batch(
                    [batch.column("row").slice(lo, hi - lo), batch.column("item").slice(lo, hi - lo), pa.array([o[0] for o in own], pa.list_(pa.int64())), pa.array([o[1] for o in own], pa.list_(pa.int64()))],
                    ["row", "item", "codes", "times"],
                )

    kind = items.schema[id_col].dataType.simpleString()
    plain = items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return plain.mapInArrow(read, f"row long, item {kind}, codes array<long>, times array<long>").where(F.size("codes") > 0)


def _postings(docs: DataFrame, terms: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of documents that have any term at all: n counts all of them, the lists hold those in ``terms``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from awardgrid.llm.kernels import slices, words

        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                w = words(data, offs, True, NOT_TERM)
                at = np.searchsorted(terms, w.hash)
                at[at == len(terms)] = 0
                hit = np.flatnonzero(terms[at] == w.hash) if len(terms) else np.zeros(0, np.int64)
                key, tf = np.unique(w.doc[hit] * (len(terms) + 1) + at[hit], return_counts=True)
                doc, term = key // (len(terms) + 1), key % (len(terms) + 1)
                some = np.flatnonzero(np.diff(w.first) > 0)
                first = np.concatenate([np.searchsorted(doc, some), [len(doc)]]).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column("id").slice(lo, hi - lo).take(pa.array(some)), pa.array(np.diff(w.first)[some].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(first), pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(pa.array(first), pa.array(tf.astype(np.int32))),
                    ],
                    ["id", "n", "terms", "tfs"],
                )

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(read, "id long, n long, terms array<int>, tfs array<int>")


def _packed(place: np.ndarray, impact: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places with any bit, and the words there of each of ``bits`` bitmaps; ``place`` ascends."""
    at, start = np.unique(place >> 6, return_index=True)
    one = np.uint64(1) << (place & 63).astype(np.uint64)
    rows = (impact.astype(np.uint64)[None, :] >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)
    return at, np.bitwise_or.reduceat(rows * one, start, axis=1)


def build_index(spark: SparkSession, docs: DataFrame, terms: np.ndarray, scratch: Scratch, name: str = "index", segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index all documents for the given terms (hashes, ascending).

    One pass over the texts writes what each document holds of them. Documents are dealt to segments
    by their place in that table, so copies and repeated ids spread evenly, and a segment's bitmaps are made in one task.
    """
    held = scratch.keep(_postings(docs, terms, id_col, text_col), f"{name}-postings")
    told = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    found = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(len(terms), np.int64)
    df[found.column("term").to_numpy()] = found.column("count").to_numpy()
    weights = np.array([math.floor(_WEIGHT * math.log((2 * told["n"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    number, words = told["n"], told["words"]
    segments = max(1, -(-number // segment))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            own = int(table.column("segment")[0].as_py())
            n = table.column("n").to_numpy().astype(object)  # exact at any size
            m = np.array([100 - 25 + (25 * x * number) // words for x in n.tolist()], np.int64)
            lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
            lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            place = np.repeat(np.arange(len(n)), np.diff(lists[0].offsets.to_numpy()))
            term, tf = lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy().astype(np.int64)
            impact = weights[term] * ((_SCALE * tf) // (_ONE * tf + 12 * m[place]))
            order = np.argsort(term, kind="stable")
            term, place, impact = term[order], place[order], impact[order]
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            cols: list[list] = [[own], [-1], [None], [None], [table.column("id").to_pylist()]]
            for lo, hi in zip(first, [*first[1:], len(term)], strict=True):
                bits = int(impact[lo:hi].max()).bit_length()
                if not bits:
                    continue
                at, packed = _packed(place[lo:hi], impact[lo:hi], bits)
                for col, value in zip(cols, (own, int(term[lo]), at.astype(np.uint16).tobytes(), packed.tobytes(), None), strict=True):
                    col.append(value)
                if len(cols[0]) >= 512:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
                    cols = [[] for _ in cols]
            if cols[0]:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        yield from _by_segment(batches, write)

    names = ["segment", "term", "at", "bits", "ids"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    placed = held.withColumn("segment", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(segments)).cast("int"))
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "segment").sortWithinPartitions("segment", F.col("id").asc_nulls_last(), "n")
    slices = scratch.keep(dealt.mapInArrow(sliced, "segment int, term int, at binary, bits binary, ids array<long>"), f"{name}-slices")
    scratch.drop(f"{name}-postings")
    return Index(slices, terms, weights, number, words)


def _by_segment(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Call ``work`` with the rows of each segment; they come sorted by segment."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        segment = batch.column("segment").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]])) if len(segment) else np.zeros(1, np.int64)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if held and held[-1].column("segment")[0].as_py() != segment[lo]:
                yield from work(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from work(held)


def add(total: np.ndarray, more: np.ndarray) -> None:
    """Add bit-sliced numbers in place: slice b of either holds bit b, the carry goes to the next."""
    carry = np.zeros_like(total[0])
    for b in range(len(total)):
        if b < len(more):
            differ = total[b] ^ more[b]
            both = total[b] & more[b]
            both |= carry & differ
            differ ^= carry
            total[b], carry = differ, both
        elif carry.any():
            total[b], carry = total[b] ^ carry, total[b] & carry
        else:
            break


def highest(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(surely in, equal at the end) of the k largest numbers above zero, as bitmaps, for each row of numbers.

    From the most significant slice down: those with the bit are taken if k allows it, else the rest are given up.
    """
    sure = np.zeros_like(total[0])
    equal = np.bitwise_or.reduce(total, 0)
    for b in range(len(total) - 1, -1, -1):
        more = sure | (equal & total[b])
        n = np.bitwise_count(more).sum(-1, dtype=np.int64)[:, None]
        equal = np.where(n > k, equal & total[b], np.where(n < k, equal & ~total[b], np.uint64(0)))
        sure = np.where(n > k, sure, more)
    return sure, equal


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class _Pass:
    """The items of one pass, and their best documents in the segments seen so far."""

    def __init__(self, rows: list[int], lists: list[np.ndarray], weights: np.ndarray, k: int):
        order = sorted(range(len(rows)), key=lambda i: -len(lists[i]))  # items of like lengths together
        self.rows, self.lists, self.k = [rows[i] for i in order], [lists[i] for i in order], k
        most = max((sum(int(weights[t]) for t in x.tolist()) for x in lists), default=0)
        self.bits = max(1, (most * 1_000_000).bit_length())  # an impact is below a million times its weight
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in rows]

    def see(self, ids: list, held: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        wide = -(-len(ids) // 64)
        for lo in range(0, len(self.rows), ITEMS_AT_ONCE):
            lists = [[held[t] for t in x.tolist() if t in held] for x in self.lists[lo : lo + ITEMS_AT_ONCE]]
            lists, own = zip(*sorted(zip(lists, range(lo, lo + len(lists)), strict=True), key=lambda x: -len(x[0])), strict=True)
            total = np.zeros((self.bits, len(lists), wide), np.uint64)
            for j in range(len(lists[0])):
                active = sum(len(x) > j for x in lists)
                more = np.zeros((max(len(x[j][1]) for x in lists[:active]), active, wide), np.uint64)
                for i in range(active):
                    at, words = lists[i][j]
                    more[: len(words), i, at] = words
                add(total[:, :active], more)
            sure, equal = highest(total, self.k)
            for i, item in enumerate(own):
                picked = _places(sure[i])
                if len(picked) < self.k:  # ids ascend by place, nulls last
                    picked = np.concatenate([picked, _places(equal[i])[: self.k - len(picked)]])
                self._merge(item, picked, total[:, i], ids)

    def _merge(self, item: int, picked: np.ndarray, total: np.ndarray, ids: list) -> None:
        if not len(picked):
            return
        bit = (total[:, picked >> 6] >> (picked & 63).astype(np.uint64)) & np.uint64(1)
        score = (bit.astype(np.int64) << np.arange(self.bits, dtype=np.int64)[:, None]).sum(0).tolist()
        found = [(-s, ids[p] is None, ids[p] or 0) for s, p in zip(score, picked.tolist(), strict=True)]
        self.best[item] = sorted(self.best[item] + found)[: self.k]

    def rest(self) -> pa.RecordBatch:
        told = [(row, None if none else i, -less) for row, best in zip(self.rows, self.best, strict=True) for less, none, i in best]
        return pa.record_batch([pa.array([t[j] for t in told], pa.int64()) for j in range(3)], ["row", "doc", "score"])


def search_index(index: Index, items: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(row, doc, score): candidates of every item (row, hashes, times), the best ``k`` of each task among them.

    For each segment the bit-sliced impacts of an item's terms are added, bitmaps for bitmaps, and the
    top is found from the most significant slice down. Terms that occur several times in an item are
    added as often.
    """
    at = [np.repeat(np.searchsorted(index.terms, codes.view(np.uint64)), times) for _, codes, times in items]
    state = ([row for row, _, _ in items], at, index.weights, k)
    asked = np.unique(np.concatenate([*at, np.zeros(0, np.int64)])).tolist()
    spark = index.slices.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Pass(*state)

        def see(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, ids = {}, []
            for part in rows:
                for term, places, bits, docs in zip(*(part.column(c).to_pylist() for c in ("term", "at", "bits", "ids")), strict=True):
                    if term < 0:
                        ids = docs
                    else:
                        places = np.frombuffer(places, np.uint16).astype(np.int64)
                        held[term] = places, np.frombuffer(bits, np.uint64).reshape(-1, len(places))
            own.see(ids, held)
            return iter(())

        yield from _by_segment(batches, see)
        yield own.rest()

    wanted = index.slices.where(F.col("term") == -1)
    if asked:
        known = spark.createDataFrame(pa.table({"term": pa.array(asked, pa.int32())}))
        wanted = wanted.union(index.slices.join(F.broadcast(known), "term").select(index.slices.columns))
    dealt = wanted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "segment").sortWithinPartitions("segment", "term")
    return dealt.mapInArrow(find, "row long, doc long, score long")


def rank_documents(
    spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 20, segment: int = SEGMENT, terms_of_index: int = TERMS_OF_INDEX, terms_of_pass: int = TERMS_OF_PASS,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of each item with the highest scores above 0.

    Terms are maximal runs of digits, letters and characters beyond ASCII in whole texts, only A-Z
    lower-cased. With N documents that have a term, L all their terms, n those of one, df the
    documents that hold a term and tf its number in one: weight w = floor(1000 ln((2N + 2) / (2df + 1))),
    length m = 75 + 25nN div L, impact w * (10^9 tf div (1000 tf + 12m)); a score sums the impacts of the
    item's terms, repeats included. Equal scores are ranked by ascending id. All of it is exact; terms
    are told apart by 64-bit hashes.

    Every document is scored against every item. Items come in groups of about ``terms_of_index`` terms,
    each of which has an index over all documents made, and these in passes of about ``terms_of_pass`` over it, so
    what a task holds is bounded: a segment's slices for the terms of a pass, and the longest text or item.
    Null and empty texts have no terms, match nothing and don't count in N. Rows with the same id are
    documents, or items, of their own; a null document id ranks after the others of its score. Documents'
    ids must be integers. Items without a match have no row; empty tables give none. Other columns are ignored.
    """
    bound_batches(spark)
    scratch = Scratch(spark, "search")
    asked = scratch.keep(item_terms(items, item_id, item_text), "items")
    terms = asked.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    indexes, passes = max(1, -(-terms // terms_of_index)), max(1, -(-min(terms, terms_of_index) // terms_of_pass))
    part = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n))
    found = []
    for i in range(indexes):
        group = asked.where(part(1, indexes) == i)
        codes = group.select(F.explode("codes").alias("c")).distinct().toArrow().column("c").to_numpy()
        if not len(codes):
            continue
        index = build_index(spark, docs, np.sort(codes.view(np.uint64)), scratch, f"index-{i}", segment, id_col, text_col)
        for j in range(passes):
            own = group.where(part(2, passes) == j).toArrow().to_pylist() if passes > 1 else group.toArrow().to_pylist()
            if own:
                own = [(r["row"], np.array(r["codes"], np.int64), np.array(r["times"], np.int64)) for r in sorted(own, key=lambda r: r["row"])]
                found.append(scratch.keep(search_index(index, own, k), f"found-{i}-{j}"))
        scratch.drop(f"index-{i}-slices")
    kind = items.schema[item_id].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], f"{item_id} {kind}, rank int, {id_col} long, score long")
    both = found[0]
    for more in found[1:]:
        both = both.union(more)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
    top = both.withColumn("rank", place).where(F.col("rank") <= k)
    return top.join(asked.select("row", "item"), "row").select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id_col), "score")
