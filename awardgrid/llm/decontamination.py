"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm.common import bound_batches
from awardgrid.llm.kernels import mix, slices, windows, words

BITS, BLOCKS = 64, 4
#: Largest Hamming distance of candidates. At similarity 0.8 the mean is 9.7 and the deviation 2.9.
RADIUS = 20
#: Items are held by every task (some MB for so many); a longer list is matched in parts, one pass over the documents each.
ITEMS_PER_PASS = 20_000


def fingerprints(shingles: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each place in ``at``: bit b is set if most of them set it."""
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), 1 << 12):
        part = mix(shingles[at[lo : lo + (1 << 12), None] + np.arange(n)])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), n, 8), axis=2)
        out[lo : lo + len(part)] = np.packbits(2 * bits.sum(1, dtype=np.int32) > n, axis=1).view(np.uint64).ravel()
    return out


class HammingIndex:
    """Items of one size by block: a fingerprint within ``radius`` of an item agrees with it, up to
    radius // BLOCKS bits, in one of the blocks at least. A block's table lists the items by their
    values there. The values that a probe's block reaches are those existing ones within so many
    bits, so the table holds each item once, and no item within the radius is missed."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.tables = []
        for b in range(BLOCKS):
            own = self._block(prints, b)
            order = np.argsort(own, kind="stable")
            values, first = np.unique(own[order], return_index=True)
            self.tables.append((values, np.append(first, len(own)), order))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        width = BITS // BLOCKS
        return ((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.uint16)

    def candidates(self, found: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(index of the fingerprint, item) of all pairs within the radius."""
        seen = [np.zeros(0, np.int64)]
        step = max(1, chunk // max(1, len(self.prints)))
        for lo in range(0, len(found), step):
            own = found[lo : lo + step]
            for b, (values, first, item) in enumerate(self.tables):
                probe, back = np.unique(self._block(own, b), return_inverse=True)
                near = np.bitwise_count(probe[:, None] ^ values[None]) <= self.radius // BLOCKS
                at, to = np.nonzero(near[back])
                n = first[to + 1] - first[to]
                i = np.repeat(at, n)
                k = item[np.repeat(first[to] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())]
                within = np.bitwise_count(own[i] ^ self.prints[k]) <= self.radius
                seen.append((lo + i[within]) * len(self.prints) + k[within])
        pair = np.unique(np.concatenate(seen))
        return pair // max(1, len(self.prints)), pair % max(1, len(self.prints))


@dataclass
class Benchmark:
    """Items by number of shingles, with an index each, and the weights of the whole benchmark's shingles."""

    ids: list[int]
    shingles: list[np.ndarray]
    #: Shingles of several items of the whole benchmark, ascending, and their weights; all others weigh 1.
    repeated: np.ndarray
    weight: np.ndarray
    percent: int
    #: By number of words, the items that are shorter than a shingle: their one shingle.
    short: dict[int, list[tuple[int, int]]]

    def __post_init__(self) -> None:
        self.sizes: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            if len(s):
                self.sizes.setdefault(len(s), []).append(i)
        self.index = {n: HammingIndex(np.array([fingerprints(self.shingles[i], np.zeros(1, np.int64), n)[0] for i in own], np.uint64)) for n, own in self.sizes.items()}
        # every shingle of the items with the sizes of those that have it
        order = {n: k for k, n in enumerate(self.sizes)}
        pairs = [np.unique(s) for s in self.shingles if len(s)] or [np.zeros(0, np.uint64)]
        keys = np.concatenate(pairs)
        of = np.concatenate([np.full(len(u), order[len(s)]) for u, s in zip(pairs, [s for s in self.shingles if len(s)], strict=False)] or [np.zeros(0, np.int64)])
        both = np.unique(np.stack([keys, of.astype(np.uint64)], 1), axis=0)
        self.known, first = np.unique(both[:, 0], return_index=True)
        self.sizes_from, self.sizes_of = np.append(first, len(both)), both[:, 1].astype(np.int64)

    def similarity(self, window: np.ndarray, item: np.ndarray) -> float:
        """Weighted Jaccard of two lists of shingles with their numbers; unknown shingles weigh as the rarest."""
        a, n = np.unique(window, return_counts=True)
        b, m = np.unique(item, return_counts=True)
        keys = np.unique(np.concatenate([a, b]))
        x, y = np.zeros(len(keys)), np.zeros(len(keys))
        x[np.searchsorted(keys, a)], y[np.searchsorted(keys, b)] = n, m
        w = np.ones(len(keys))
        if len(self.repeated):
            at = np.minimum(np.searchsorted(self.repeated, keys), len(self.repeated) - 1)
            w = np.where(self.repeated[at] == keys, self.weight[at], 1.0)
        return float((w * np.minimum(x, y)).sum() / (w * np.maximum(x, y)).sum())

    def matches(self, shingles: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first shingle, shingles, similarity): the best window of each item that is similar enough, the first at a tie.

        Windows as long as an item begin at every word; a document shorter than the item is one window
        as a whole. A window without any shingle of the benchmark has similarity 0 to all items, and one
        without any of an item's has similarity 0 to that, so only windows with some, and only sizes of
        items that share some with the document, are fingerprinted.
        """
        if not len(shingles) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        known = self.known[at] == shingles
        hit = np.concatenate([[0], np.cumsum(known)])
        if not hit[-1]:
            return []
        met = {int(k) for a in np.unique(at[known]) for k in self.sizes_of[self.sizes_from[a] : self.sizes_from[a + 1]]}
        best: dict[int, tuple[float, int, int]] = {}
        whole = None
        for place, (n, own) in enumerate(self.sizes.items()):
            if place not in met:
                continue
            size = min(n, len(shingles))
            begin = np.flatnonzero(hit[size:] > hit[:-size])
            if not len(begin):
                continue
            prints = whole if size < n and whole is not None else fingerprints(shingles, begin, size)
            whole = prints if size < n else whole
            which, item = self.index[n].candidates(prints)
            for w, k in zip(begin[which].tolist(), item.tolist(), strict=True):
                i = own[k]
                s = self.similarity(shingles[w : w + size], self.shingles[i])
                if 100 * s >= self.percent - 1e-9 and (i not in best or s > best[i][0]):
                    best[i] = (s, w, size)
        return [(i, w, size, s) for i, (s, w, size) in sorted(best.items())]


def load_benchmark(benchmark: DataFrame, shingle: int, percent: int, id_col: str = "item_id", text_col: str = "text") -> list[Benchmark]:
    """The benchmark in parts of at most ``ITEMS_PER_PASS`` items. A shingle's weight falls with the
    number of items of the whole benchmark that have it, from 1 for one item."""
    told = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).distinct().orderBy(id_col, text_col)
    rows = [(r[0], *text_shingles(r[1], shingle)) for r in told.toLocalIterator()]  # texts don't stay, only their hashes
    every = [r[1:] for r in rows]
    known, count = np.unique(np.concatenate([*[np.unique(s) for k, s in every if k == shingle], np.zeros(0, np.uint64)]), return_counts=True)
    repeated, weight = known[count > 1], 1 / (1 + np.log(count[count > 1]))
    out = []
    for lo in range(0, len(rows), ITEMS_PER_PASS):
        own, short = [], {}
        for i, k, s in rows[lo : lo + ITEMS_PER_PASS]:
            own.append(s if k == shingle else s[:0])
            if 0 < k < shingle:
                short.setdefault(k, []).append((int(s[0]), i))
        out.append(Benchmark([i for i, *_ in rows[lo : lo + ITEMS_PER_PASS]], own, repeated, weight, percent, short))
    return out


def text_shingles(text: str, shingle: int) -> tuple[int, np.ndarray]:
    """Words in a shingle, and all shingles of a text in order; a shorter text has its whole sequence as one."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = words(data, np.array([0, len(data)]), lower=True)
    k = min(shingle, len(w.hash))
    return k, windows(w, k)[0] if k else np.zeros(0, np.uint64)


def find_contamination(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, item id, first_word, n_words, similarity) of every document and benchmark item that it holds.

    Every window of a document with as many shingles as an item is compared with the items of that
    size, and a document of fewer shingles than an item as a whole: SimHash fingerprints within
    ``RADIUS`` bits, found by multi-index blocks, are candidates, and their weighted-shingle similarity,
    computed exactly, must reach ``percent``/100. Of several such windows the most similar is
    reported, with its own number of words. Documents that hold no item give no rows.

    Words are compared without regard to the case of A-Z. An item of fewer words than ``shingle`` has
    its whole sequence as its one shingle, and is looked for as such. Items and documents without
    words or with null text match nothing; so do null item ids. Null document ids are reported as
    null. Repeated rows are reported each; of windows equally similar the first counts. An empty
    benchmark or table gives no rows. Other columns are ignored, whatever their names. Whole texts of any length are scanned in one map without a shuffle; the benchmark travels to the tasks in parts of bounded
    numbers of items, each with the weights of all shingles that several items of the whole have.
    """
    bound_batches(spark)
    out = None
    for part in load_benchmark(benchmark, shingle, percent, item_col, item_text_col):
        held = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench: Benchmark = held.value
            for batch in batches:
                for lo, hi, data, offs in slices(batch.column("text")):
                    w = words(data, offs, lower=True)
                    h, at = windows(w, shingle)
                    cut = np.searchsorted(at, w.first)
                    rows = []
                    for d in range(hi - lo):
                        for i, first, size, s in bench.matches(h[cut[d] : cut[d + 1]]):
                            rows.append((lo + d, bench.ids[i], first, size + shingle - 1, s))
                    for k, items in bench.short.items():
                        h, at = windows(w, k)
                        for x, i in items:
                            found_at = at[h == np.uint64(x)]
                            docs_of, once = np.unique(w.doc[found_at], return_index=True)
                            rows += [(lo + int(d), i, int(f - w.first[d]), k, 1.0) for d, f in zip(docs_of, found_at[once], strict=True)]
                    cols = list(zip(*rows, strict=True)) or [[]] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.record_batch([batch.column("doc").take(pa.array(list(cols[0]), pa.int64())), *[pa.array(list(c), k) for c, k in zip(cols[1:], kinds, strict=True)]], ["doc", "item", "first_word", "n_words", "similarity"])

        rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        found = rows.mapInArrow(scan, "doc long, item long, first_word long, n_words long, similarity double")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "doc long, item long, first_word long, n_words long, similarity double")
    return out.withColumnRenamed("doc", id_col).withColumnRenamed("item", item_col)
