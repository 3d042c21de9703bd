"""Spelling variants: words at one edit, found in forward and reversed sorted dictionaries (operator 11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm.common import Scratch, bound_batches

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block of more words, or of more letters between its shared halves, is subdivided before one task gets it.
MOST_WORDS, MOST_LETTERS = 10_000, 32 << 20
#: Blocks that a task gets are halved further down to this many words.
SMALL = 48
PAIRS_AT_ONCE = 400_000
FEW_BLOCKS = 200_000


def lower_ascii(word: Column) -> Column:
    """Only A-Z lower-cased; all-ASCII words take the quick way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def count_words(docs: DataFrame, min_length: int = 7, min_count: int = 2, edit: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased, with their numbers.

    ``edit`` maps (id, word) to the word that counts; it may shorten a word, never lengthen it.
    Counts are summed where the rows are before they travel. Words below ``min_length`` code points or
    ``min_count`` occurrences are left out.
    """
    runs = docs.select(F.col(id_col).alias("__id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("run"))
    words = runs.select("__id", lower_ascii(F.col("run")).alias("word"))
    if edit is not None:
        words = words.select(edit(F.col("__id"), F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _block(at: str, length: Column, head: Column, tail: Column) -> Column:
    """A block's name: the shorter word's length, the sizes of the shared halves, and the halves. Names
    sort by the sizes first, then as the dictionary does (``at``: a word's column)."""
    halves = F.concat(F.substring(at, F.lit(1), head), F.substring(at, F.length(at) - tail + 1, tail))
    return F.concat(*[F.concat(F.lpad(x.cast("string"), 9, "0"), F.lit(":")) for x in (length, head, tail)], halves)


def _dictionaries(words: DataFrame, min_length: int) -> DataFrame:
    """Every word in the forward dictionary (shared first half) and in the reversed one (shared last half), as
    the shorter or an equally long word, and as the longer one."""
    m = F.length("word")
    as_one = F.explode(F.when(m > min_length, F.array(m, m - 1)).otherwise(F.array(m)))
    sized = words.select("word", "n", as_one.alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    kinds = F.explode(F.array(F.struct(half.alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(0).alias("head"), (F.col("size") - half).alias("tail"))))
    return sized.select("word", "n", "size", kinds.alias("k")).select("word", "n", "size", "k.head", "k.tail")


def _subdivide(rows: DataFrame) -> DataFrame:
    """Both halves of what lies between a block's shared parts: one edit leaves one of them intact."""
    half = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
    kinds = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("size") - F.col("head") - half).alias("tail")),
    )
    return rows.select("word", "n", "size", F.explode(kinds).alias("k")).select("word", "n", "size", "k.head", "k.tail")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", _block("word", F.col("size"), F.col("head"), F.col("tail")))


def _bounded_blocks(scratch: Scratch, words: DataFrame, min_length: int, most: int) -> DataFrame:
    """Rows of blocks of at most ``most`` words; larger ones are subdivided, again and again.

    A block's words differ by a letter of 90, so one that cannot be halved (one letter between the shared parts) has 8,190 words at most.
    """
    rows = scratch.keep(_named(_dictionaries(words, min_length)), "blocks-0")
    for k in range(1, 64):
        between = F.sum(F.length("word") - F.col("head") - F.col("tail"))
        sizes = rows.where("size - head - tail > 1").groupBy(F.xxhash64("block").alias("hash")).agg(F.count("*").alias("c"), between.alias("letters"))
        over = scratch.keep(sizes.where((F.col("c") > most) | (F.col("letters") > MOST_LETTERS)).select("hash"), f"over-{k}")
        n = over.count()
        if not n:
            return rows
        over = F.broadcast(over) if n <= FEW_BLOCKS else over
        marked = rows.join(over.select("hash", F.lit(1).alias("hot")), (F.xxhash64("block") == F.col("hash")) & (F.col("size") - F.col("head") - F.col("tail") > 1), "left")
        plain = marked.where("hot is null").select("word", "n", "size", "head", "tail", "block")
        rows = scratch.keep(plain.union(_named(_subdivide(marked.where("hot = 1"))).select(plain.columns)), f"blocks-{k}")
        scratch.drop(f"blocks-{k - 1}")
    raise RuntimeError("blocks did not become small")


class _Run:
    """Rows of blocks with the same sizes (length of the shorter words, shared head and tail)."""

    def __init__(self, words: list[bytes], n: np.ndarray, block: np.ndarray, size: int, head: int, tail: int):
        self.words, self.n, self.size, self.head, self.tail = words, n, size, head, tail
        length = np.fromiter(map(len, words), np.int64, len(words))
        self.long = length > size
        t = size - head - tail
        self.mid = np.zeros((len(words), t + 1), np.uint8)
        text = np.frombuffer(b"".join(words), np.uint8)
        first = np.concatenate([[0], np.cumsum(length)[:-1]]) + head
        self.mid[:, :t] = text[first[:, None] + np.arange(t)]
        self.mid[self.long, t] = text[first[self.long] + t]
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.lexsort((self.long, block))
        self._halve(order, block[order], head, tail)

    def _halve(self, rows: np.ndarray, block: np.ndarray, head: int, tail: int) -> None:
        """``rows`` stand sorted by block; small blocks are compared, others go on by the intact half."""
        t = self.size - head - tail
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        count = np.diff(np.concatenate([first, [len(rows)]]))
        big = np.repeat((count > SMALL) & (t > 1), count)
        if not big.all():
            keep = ~big
            self._compare(rows[keep], block[keep], head, tail)
        if big.any():
            rows, block = rows[big], block[big]
            half = t // 2
            lo = head - self.head
            shared = [(self.mid[rows, lo : lo + half], head + half, tail)]
            at = lo + half + self.long[rows]  # a longer word's last part stands one place further
            shared.append((self.mid[rows[:, None], at[:, None] + np.arange(t - half)], head, tail + t - half))
            for part, new_head, new_tail in shared:
                whole = np.concatenate([block.astype(">u8")[:, None].view(np.uint8).reshape(len(rows), 8), part], 1)
                _, new = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_inverse=True)
                order = np.lexsort((self.long[rows], new))
                self._halve(rows[order], new[order], new_head, new_tail)

    def _compare(self, rows: np.ndarray, block: np.ndarray, head: int, tail: int) -> None:
        """All pairs of a block in which a word is not the longer one of both (these stand first)."""
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        end = np.repeat(np.concatenate([first[1:], [len(rows)]]), np.diff(np.concatenate([first, [len(rows)]])))
        short = np.flatnonzero(~self.long[rows])
        count = end[short] - short - 1
        short, count = short[count > 0], count[count > 0]
        total = np.cumsum(count)
        lo = 0
        while lo < len(short):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            c = count[lo:hi]
            a = np.repeat(short[lo:hi], c)
            b = a + 1 + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            self._verify(rows[a], rows[b], head, tail)
            lo = hi

    def _verify(self, a: np.ndarray, b: np.ndarray, head: int, tail: int) -> None:
        """Keep pairs at exactly one edit, each in one block only: where its common beginning reaches
        over the head, but not up to the tail of a block that came from last halves."""
        t = self.size - head - tail
        lo = head - self.head
        x, y = self.mid[a, lo : lo + t], self.mid[b, lo : lo + t + 1]
        same = x == y[:, :t]
        lead = np.where(same.all(1), t, np.argmin(same, 1)) if t else np.zeros(len(a), np.int64)
        ahead = x == y[:, 1 : t + 1]
        trail = np.where(ahead.all(1), t, np.argmin(ahead[:, ::-1], 1)) if t else np.zeros(len(a), np.int64)
        long = self.long[b]
        near = np.where(long, lead + trail >= t, (~same).sum(1) == 1)
        if tail:
            near &= lead < t
        self.found.append((a[near], b[near]))

    def nearest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of its near words, row of the best one) of rows that have any."""
        if not self.found:
            return (np.zeros(0, np.int64),) * 3
        a, b = (np.concatenate(x) for x in zip(*self.found, strict=True))
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        held = np.unique(dst)
        rank = np.zeros(len(self.words), np.int64)
        rank[sorted(held.tolist(), key=self.words.__getitem__)] = np.arange(len(held))
        order = np.lexsort((rank[dst], -self.n[dst], src))
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, np.int64)
        return src[first], np.diff(np.concatenate([first, [len(src)]])), dst[first]


def _near_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and word to (word, near, best, best_n): sums over the blocks of this task's stretch."""
    held: list[pa.RecordBatch] = []

    def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        block = table.combine_chunks().column("block")
        changes = np.concatenate([[True], pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)).to_numpy()])
        number = np.cumsum(changes) - 1
        count = np.bincount(number)
        sizes = np.stack([table.column(c).to_numpy() for c in ("size", "head", "tail")])
        cut = np.flatnonzero(np.concatenate([[True], (sizes[:, 1:] != sizes[:, :-1]).any(0), [True]]))
        words, n = table.column("word"), table.column("n").to_numpy()
        several = count[number] > 1
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            at = lo + np.flatnonzero(several[lo:hi])
            if not len(at):
                continue
            own = [w.encode("latin-1") for w in words.take(pa.array(at)).to_pylist()]
            run = _Run(own, n[at], number[at], *(int(x) for x in sizes[:, lo]))
            src, near, best = run.nearest()
            if len(src):
                yield pa.record_batch(
                    [pa.array([own[i].decode("latin-1") for i in src.tolist()]), pa.array(near), pa.array([own[i].decode("latin-1") for i in best.tolist()]), pa.array(run.n[best])],
                    ["word", "near", "best", "best_n"],
                )

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * MOST_WORDS:
            table = pa.Table.from_batches(held)
            names = table.column("block")
            last = names[-1].as_py()
            at = table.num_rows - 1
            while at and names[at - 1].as_py() == last:
                at -= 1
            yield from judged(table.slice(0, at))
            held = table.slice(at).to_batches()
    if held:
        yield from judged(pa.Table.from_batches(held))


def near_words(scratch: Scratch, words: DataFrame, min_length: int = 7, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, n_near, best, best_n) of a written table of distinct words (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one of the other. One
    edit leaves a half intact, so near words share the first or the last half (of the shorter one).
    The words sorted forward and the words sorted from their end hold those with a shared half side by
    side; ranges are dealt to tasks and scanned block by block. A block of over ``most`` words is
    subdivided by the halves of what lies between, before any task gets it, whole blocks only. Each
    pair is verified letter by letter, and counted in one block.
    """
    rows = _bounded_blocks(scratch, words, min_length, most)
    dealt = rows.repartitionByRange(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "word")
    found = dealt.mapInArrow(_near_in_blocks, "word string, near long, best string, best_n long")
    both = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n")).union(
        found.select("word", F.lit(0).cast("long"), "near", "best", "best_n")
    )
    choice = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), choice.alias("c")).select("word", "n", "n_near", F.col("c.best").alias("best"), (-F.col("c.less")).alias("best_n"))


def follow(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form), form not null: forms followed to the last one.

    Every form is more frequent than its word, so there is no circle; each round doubles the steps.
    """
    roots, held = forms.select("word", F.col("form").alias("root")), None
    for k in range(64):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = f"roots-{k}"
        following = scratch.keep(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), new)
        moved = not following.where("moved").isEmpty()
        if held:
            scratch.drop(held)
        roots, held = following.select("word", "root"), new
        if not moved:
            return roots
    raise RuntimeError("forms lead in a circle")


def group_variants(
    spark: SparkSession, docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, edit: Callable[[Column, Column], Column] | None = None, most: int = MOST_WORDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of whole texts (``count_words``).

    A word's form is its near word (``near_words``) of largest n, equal ones by code points, if that n is
    ``ratio`` times the word's or more, else null (with a null form_n); root follows forms to the last,
    and is the word itself where there is none. Words without near words have n_near 0. Null and empty
    texts have no words; repeated rows count again; a null id reaches ``edit`` as null. An empty table
    gives no rows. Texts and words of any length are taken whole. Other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    bound_batches(spark)
    scratch = Scratch(spark, "spelling")
    words = scratch.keep(count_words(docs, min_length, min_count, edit, id_col, text_col), "words")
    near = near_words(scratch, words, min_length, most)
    with_form = F.col("best_n") >= ratio * F.col("n")
    told = scratch.keep(near.select("word", F.when(with_form, F.col("best")).alias("form"), "n", "n_near", F.when(with_form, F.col("best_n")).alias("form_n")), "near")
    roots = follow(scratch, told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
