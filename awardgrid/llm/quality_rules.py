"""Line labelling by a linear-chain conditional random field (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm.common import bound_batches
from awardgrid.llm.kernels import BLANK, LOW52, mix, powers, slices, windows, words

SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "symbols", "exclaims", "upper", "digits", "letters", "few_words", "many_words", "closed", "repeated_line", "repeated_words", "word_length")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYM, _EXCL, _CLOSE = _table(SYMBOLS), _table(b"!"), _table(b".?:;\"")
_UP, _DIGIT = _table(bytes(range(0x41, 0x5B))), _table(bytes(range(0x30, 0x3A)))
_LETTER = _table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


@dataclass
class Measured:
    """A slice's base counts by document, and its lines: document, number of words, features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_first: np.ndarray
    line_words: np.ndarray
    x: np.ndarray


def measure(data: np.ndarray, offs: np.ndarray) -> Measured:
    """Lines are what ``\\n`` splits; a line without a word stays in the sequence with no weight."""
    n, docs = len(data), len(offs) - 1
    w = words(data, offs, lower=False)
    sums_of = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    newline = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offs[:-1], newline + 1]))  # of lines; an empty text has one empty line
    stop = np.concatenate([begin[1:], [n]])
    line_doc = np.repeat(np.arange(docs), np.diff(np.searchsorted(newline, offs)) + 1)
    ends_line = np.zeros(len(begin), bool)
    last = np.cumsum(np.bincount(line_doc, minlength=docs)) - 1
    ends_line[last] = True
    stop = np.where(ends_line, stop, stop - 1)
    chars = np.maximum(stop - begin, 1)
    head = data & 0xC0 != 0x80
    upto = {k: sums_of(t[data]) for k, t in (("symbols", _SYM), ("exclaims", _EXCL), ("upper", _UP), ("digits", _DIGIT), ("letters", _LETTER), ("solid", ~BLANK))}
    sums = {k: c[stop] - c[begin] for k, c in upto.items()}
    wf, wl = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    line_words = wl - wf
    word_bytes = sums["solid"]

    up, down = powers(n + 1)
    rolled = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(0x51ED)) * up[:n] * np.uint64(0xD6E8FEB86659FD93), out=rolled[1:])
    h = mix((rolled[stop] - rolled[begin]) * down[begin] + chars.astype(np.uint64))
    key = (line_doc.astype(np.uint64) << np.uint64(52)) | (h & LOW52)
    has = np.flatnonzero(line_words > 0)
    _, first = np.unique(key[has], return_index=True)
    dup = np.zeros(len(begin), bool)
    dup[has] = True
    dup[has[first]] = False

    g, at = windows(w, 3)
    key = (w.doc[at].astype(np.uint64) << np.uint64(52)) | (g & LOW52)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    covered = np.zeros(len(w.hash), bool)
    for j in range(3):
        covered[twice + j] = True
    repeat = np.concatenate([[0], np.cumsum(covered)])

    closing = np.zeros(len(begin), bool)
    some = np.flatnonzero(line_words > 0)
    closing[some] = _CLOSE[data[w.end[wl[some] - 1] - 1]]
    share = lambda v: v / chars
    x = np.stack([
        np.ones(len(begin)), share(sums["symbols"]), share(sums["exclaims"]) * 4, share(sums["upper"]), share(sums["digits"]) * 4, share(sums["letters"]),
        line_words < 3, line_words > 40, closing, dup, (repeat[wl] - repeat[wf]) / np.maximum(line_words, 1), np.minimum(word_bytes / np.maximum(line_words, 1) / 12, 2),
    ], 1).astype(np.float64)
    line_first = np.searchsorted(line_doc, np.arange(docs + 1))
    return Measured(
        np.diff(w.first), np.diff(sums_of(head & ~BLANK[data])[offs]), np.diff(upto["symbols"][offs]), np.bincount(line_doc[dup], minlength=docs),
        np.diff(repeat[w.first]), line_first, line_words, x,
    )


@dataclass
class LineField:
    """Weights for the label *content* (boilerplate has none), between labels, and of the first line."""

    weight: np.ndarray = field(default_factory=lambda: np.eye(1, len(FEATURES))[0])
    between: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(x)), x @ self.weight], 1)


def _turns(line_first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(t, documents with over t lines), for steps that handle all documents at once."""
    n = np.diff(line_first)
    order = np.argsort(-n, kind="stable")
    ranked = -n[order]
    for t in range(int(n.max(initial=0))):
        yield t, order[: np.searchsorted(ranked, -t)]


BLOCK = 256


def viterbi(model: LineField, x: np.ndarray, line_first: np.ndarray) -> np.ndarray:
    """The likeliest labels (1: content) of all lines; at a tie, content.

    Documents are cut into blocks of ``BLOCK`` lines. All blocks advance together, once for each label
    that the line before the block may have; a document's blocks are then joined in order, and the
    labels read back. So a text of a million lines takes some thousand turns, not a million.
    """
    e = model.scores(x)
    n = np.diff(line_first)
    blocks = -(-n // BLOCK)
    of = np.repeat(np.arange(len(n)), blocks)  # the document of each block
    nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = line_first[:-1][of] + nth * BLOCK
    bounds = np.concatenate([begin, line_first[-1:]]).astype(np.int64)
    back = np.zeros((len(x), 2, 2), np.int8)  # line, label before the block, own label -> label before
    best = np.zeros((len(of), 2, 2))  # block, label before the block, last label
    for t, b in _turns(bounds):
        at = bounds[b] + t
        if t:
            via = best[b][:, :, :, None] + model.between[None, None]
            back[at] = np.where(via[:, :, 1] >= via[:, :, 0], 1, 0)
            best[b] = via.max(2) + e[at][:, None, :]
        else:
            opens = np.where((nth[b] == 0)[:, None, None], model.first[None, None], model.between[None])
            best[b] = opens + e[at][:, None, :]
    # join the blocks: the j-th of all documents at once
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    total = np.zeros((len(n), 2))
    came = np.zeros((len(of), 2), np.int8)  # block, last label -> label before the block
    last = np.zeros(len(of), np.int8)
    for j, d in _turns(block_first):
        b = block_first[d] + j
        if j:
            via = total[d][:, :, None] + best[b]
            came[b] = np.where(via[:, 1] >= via[:, 0], 1, 0)
            total[d] = via.max(1)
        else:
            total[d] = best[b][:, 0]
    now = np.where(total[:, 1] >= total[:, 0], 1, 0)
    for j, d in reversed(list(_turns(block_first))):
        b = block_first[d] + j
        last[b] = now[d]
        now[d] = came[b, now[d]]
    # labels within the blocks, from their ends
    prior = came[np.arange(len(of)), last]
    label, now = np.zeros(len(x), np.int8), last.astype(np.int64).copy()
    for t, b in reversed(list(_turns(bounds))):
        at = bounds[b] + t
        label[at] = now[b]
        now[b] = back[at, prior[b], now[b]]
    return label


def fit_lines(x: np.ndarray, gold: np.ndarray, steps: int = 30, l2: float = 0.001) -> np.ndarray:
    """Weights of single lines (logistic regression by Newton steps), without their neighbours."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(len(w))
        w += np.linalg.solve(curve, x.T @ (gold - p) / len(x) - l2 * w)
    return w


def fit_field(x: np.ndarray, line_first: np.ndarray, gold: np.ndarray, steps: int = 250, l2: float = 0.02, rate: float = 0.1) -> LineField:
    """Maximum likelihood by forward-backward sums and Adam steps, all documents at once.

    ``gold`` has the documents' labels. A bad document may have good lines: lines of documents with
    label 0 that a line-by-line fit takes for content get that label before the field is fitted, so
    the weights between labels tell how labels alternate within a document.
    """
    gold = np.where(x @ fit_lines(x, gold) > 0, 1, 0) | gold
    d = len(FEATURES)
    theta, m, v = np.zeros(d + 6), np.zeros(d + 6), np.zeros(d + 6)
    docs = len(line_first) - 1
    turns = list(_turns(line_first))
    first = line_first[:-1]
    follows = np.ones(len(x), bool)
    follows[first[np.diff(line_first) > 0]] = False
    nxt = np.flatnonzero(follows)
    seen = np.concatenate([x.T @ gold, np.bincount(gold[nxt - 1] * 2 + gold[nxt], minlength=4), np.bincount(gold[first], minlength=2)]).astype(float)
    log_sum = lambda a, axis: np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))
    for step in range(1, steps + 1):
        w, between, start = theta[:d], theta[d : d + 4].reshape(2, 2), theta[d + 4 :]
        e = np.stack([np.zeros(len(x)), x @ w], 1)
        ahead, behind = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for t, k in turns:
            at = line_first[k] + t
            ahead[at] = e[at] + (log_sum(ahead[at - 1][:, :, None] + between[None], 1) if t else start)
        z = log_sum(ahead[line_first[1:] - 1], 1)
        for t, k in reversed(turns):
            at = line_first[k] + t
            inner = at[at + 1 < line_first[k + 1]]
            behind[inner] = log_sum(between[None] + (e[inner + 1] + behind[inner + 1])[:, None, :], 2)
        zs = np.repeat(z, np.diff(line_first))
        p = np.exp(ahead + behind - zs[:, None])
        pair = np.exp(ahead[nxt - 1][:, :, None] + between[None] + (e[nxt] + behind[nxt])[:, None, :] - zs[nxt][:, None, None])
        expected = np.concatenate([x.T @ p[:, 1], pair.sum(0).ravel(), p[first].sum(0)])
        g = (seen - expected) / docs - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineField(theta[:d], theta[d : d + 4].reshape(2, 2), theta[d + 4 :])


def learn_field(docs: DataFrame, labels: DataFrame, sample: int = 1500, most_lines: int = 400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """Fit on about ``sample`` labelled documents, those with the least hashes of their id.

    A line of a document takes the document's label (1: content) at first, see ``fit_field``. Documents whose crc32 of the id
    as text, modulo 4, is 2 are never learned from, nor those of over ``most_lines`` lines. Without
    two labels to tell apart, every line is content.
    """
    known = labels.where(
        F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2)
    ).groupBy(id_col).agg(F.min(label_col).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return LineField()
    rate = F.when(F.col("y") == 1, sample / 2 / counts[1]).otherwise(sample / 2 / counts[0])
    picked = known.where(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 52)) < rate * float(1 << 52)).select(F.col(id_col).alias("__id"), "y")
    held = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    # a row for each id, however often it is repeated
    rows = held.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.min(F.struct("text", "y")).alias("r")).select("r.*")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_pylist()
            for lo, hi, data, offs in slices(batch.column("text")):
                got = measure(data, offs)
                some = [i for i in range(hi - lo) if got.line_first[i + 1] - got.line_first[i] <= most_lines]
                yield pa.record_batch(
                    [pa.array([y[lo + i] for i in some], pa.int64()), pa.array([got.x[got.line_first[i] : got.line_first[i + 1]].astype("<f8").tobytes() for i in some], pa.binary())],
                    ["y", "x"],
                )

    held = sorted((r["y"], bytes(r["x"])) for r in rows.mapInArrow(features, "y long, x binary").collect())
    if len({y for y, _ in held}) < 2:
        return LineField()
    xs = [np.frombuffer(x, "<f8").reshape(-1, len(FEATURES)) for _, x in held]
    gold = np.concatenate([np.full(len(x), y) for (y, _), x in zip(held, xs, strict=True)])
    return fit_field(np.concatenate(xs), np.concatenate([[0], np.cumsum([len(x) for x in xs])]), gold)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", model: LineField | None = None) -> DataFrame:
    """(id, base counts, base_failed, kept, n_lines, n_content_lines, content_share) of every row.

    Viterbi decoding marks each line content or boilerplate; ``content_share`` is the share of words
    that stand in content lines, and a document that passes the base is kept if it is at least
    ``least_share``. Where both labels are as likely, a line is content. Null or empty text has no
    words, so its base fails. Repeated rows are kept as they are, null ids too. Other columns of both
    tables are ignored, whatever their names. An empty table gives no rows; without labels of both
    kinds every line is content. Whole texts of any length; one map over the rows, no shuffle of them.
    """
    bound_batches(spark)
    model = model or learn_field(docs, labels, id_col=id_col, text_col=text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                got = measure(data, offs)
                content = viterbi(model, got.x, got.line_first).astype(np.int64)
                add = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[got.line_first])  # noqa: B023, E731
                share = add(content * got.line_words) / np.maximum(got.n_words, 1)
                failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
                yield pa.record_batch(
                    [
                        batch.column("id").slice(lo, hi - lo), *[pa.array(getattr(got, c).astype(np.int64)) for c in COUNTS],
                        pa.array(failed), pa.array(~failed & (share >= least_share)),
                        pa.array(np.diff(got.line_first).astype(np.int64)), pa.array(add(content)), pa.array(share),
                    ],
                    ["id", *COUNTS, "base_failed", "kept", "n_lines", "n_content_lines", "content_share"],
                )

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(judge, f"id long, {kinds}, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double")
    return out.withColumnRenamed("id", id_col)
