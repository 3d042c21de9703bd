"""Toxicity by non-negative positive-unlabelled learning on hashed character n-grams (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm.common import Scratch, bound_batches

#: Letters that the n-grams see: lower-case ASCII letters and all bytes of other characters; the rest is blank.
_LETTER = np.zeros(256, np.uint32)
_LETTER[0x61:0x7B] = np.arange(1, 27)
_LETTER[0x41:0x5B] = np.arange(1, 27)
_LETTER[0x80:] = np.arange(27, 155)
SIZES = (4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
_ODD = np.random.Generator(np.random.PCG64(131)).integers(0, 2**31, 12, np.uint32) * np.uint32(2) + np.uint32(1)


def gram_buckets(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n letters or blanks from every byte on), for n of 4, 5 and 6."""
    x = _LETTER[data]
    h = np.zeros(len(x), np.uint32)
    for j in range(min(max(SIZES), len(x))):
        h = h[: len(x) - j] + x[j:] * _ODD[j]
        if j + 1 in SIZES:
            yield j + 1, (h * _ODD[6 + j]) >> np.uint32(32 - BITS)


def word_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Words of each text of the slice, by the same letters."""
    solid = np.concatenate([[False], _LETTER[data] > 0])
    first = np.concatenate([[0], np.cumsum(solid[1:] & ~solid[:-1])])
    return first[offs[1:]] - first[offs[:-1]]


def document_buckets(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """``text << BITS | bucket``, ascending and distinct, of a slice's texts (4,096 at most, so 32 bits hold it)."""
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.uint32) << np.uint32(BITS), np.diff(offs))
    keys = [(doc[: len(b)] | b)[doc[: len(b)] == doc[n - 1 :]] for n, b in gram_buckets(data)]
    key = np.sort(np.concatenate([*keys, np.zeros(0, np.uint32)]))
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


@dataclass
class Lexicon:
    """Which buckets are features; a feature's number is its place among them."""

    buckets: np.ndarray
    known: np.ndarray = field(init=False)

    def __post_init__(self):
        self.known = np.zeros(BUCKETS, bool)
        self.known[self.buckets] = True

    def rates(self, data: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value): how often a feature occurs for each ``window`` words of its text, 1 at most."""
        k = max(len(self.buckets), 1)
        keys = [np.zeros(0, np.int64)]
        for n, bucket in gram_buckets(data):
            at = np.flatnonzero(self.known[bucket])
            doc = np.searchsorted(offs, at, "right") - 1
            at, doc = (v[at + n <= offs[doc + 1]] for v in (at, doc))
            keys.append(doc * k + np.searchsorted(self.buckets, bucket[at]))
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        doc = key // k
        words = np.maximum(word_counts(data, offs), window)
        return doc, key % k, np.minimum(1.0, count * window / words[doc])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class PuModel:
    """A linear classifier over the lexicon's rates, and the words of a window."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    window: int

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, feature, value = self.lexicon.rates(data, offs, self.window)
        z = np.bincount(doc, self.weights[feature] * value, len(offs) - 1) if len(doc) else np.zeros(len(offs) - 1)
        return _sigmoid(z + self.bias)


class _Rows:
    """Sparse rows: the features and values of document i stand from first[i] to first[i + 1]."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.first = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int64)
        self.feature = np.concatenate([*[r[0] for r in rows], np.zeros(0, np.int64)]).astype(np.int64)
        self.value = np.concatenate([*[r[1] for r in rows], np.zeros(0)]).astype(float)

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``rows``, feature, value) of some rows."""
        n = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.feature[at], self.value[at]


def fit_pu(positive: _Rows, unlabelled: _Rows, features: int, prior: float, steps: int = 600, batch: int = 512, rate: float = 0.05, decay: float = 1e-4, seed: int = 13) -> tuple[np.ndarray, float]:
    """Weights and bias that make the non-negative risk least, by ``steps`` steps of Adam over small batches.

    The risk of a positive-unlabelled sample is ``prior * (loss of positives as positive)`` plus
    ``(loss of unlabelled as negative) - prior * (loss of positives as negative)``. The last two
    estimate the loss of negatives, which cannot be below zero: where a batch puts them there the
    classifier has begun to learn single documents by heart, and that batch takes a step back on
    that part instead (Kiryo et al. 2017). The loss is the sigmoid one, which is bounded: toxic texts
    among the unlabelled cannot pull the classifier far.
    """
    r = np.random.Generator(np.random.PCG64(seed))
    w, b = np.zeros(features + 1), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(features + 1), np.zeros(features + 1), 0
    total = len(positive) + len(unlabelled)
    rounds = max(1, -(-total // batch))

    def slopes(rows: _Rows, picked: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        """Mean loss of taking rows as ``sign``, and its gradient (the bias stands last)."""
        doc, feature, value = rows.take(picked)
        z = np.bincount(doc, w[feature] * value, len(picked)) + b
        loss = _sigmoid(-sign * z)
        slope = -sign * loss * (1 - loss) / len(picked)
        grad = np.bincount(feature, value * slope[doc], features + 1)
        grad[features] = slope.sum()
        return float(loss.mean()), grad

    for _ in range(-(-steps // rounds)):
        ps, us = r.permutation(len(positive)), r.permutation(len(unlabelled))
        for k in range(rounds):
            p = ps[k * len(ps) // rounds : max((k + 1) * len(ps) // rounds, k * len(ps) // rounds + 1)]
            u = us[k * len(us) // rounds : max((k + 1) * len(us) // rounds, k * len(us) // rounds + 1)]
            _, toxic = slopes(positive, p, 1.0)
            clean_p, from_p = slopes(positive, p, -1.0)
            clean_u, from_u = slopes(unlabelled, u, -1.0)
            if clean_u - prior * clean_p >= 0:
                grad = prior * toxic + from_u - prior * from_p
            else:
                grad = prior * from_p - from_u
            grad[:features] += decay * w[:features]
            t += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w[:features] -= step[:features]
            b -= float(step[features])
    return w[:features], b


def _fifth(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def learn_toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 12000, prior: float | None = None, features: int = 512,
    window: int = 150, least: int = 4, apart: float = 5.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> PuModel:
    """Fit on about ``positives`` documents that are confirmed toxic and ``unlabelled`` others, whatever their labels.

    Both samples are those with the least hashes of their id among documents that aren't held out
    (crc32 of the id as text, modulo 5, isn't 0; id not null). Negative labels are never examples: they only count for the
    ``prior``, the share of toxic documents, which is taken over all labels that aren't held out unless it is
    given. Features are the ``features`` n-gram buckets that stand out most among the positives, each in ``least`` of them or more
    and ``apart`` standard errors more frequent there (document counts are summed where the rows are). An id with two labels counts as toxic. Without
    any positive example the model is the constant prior, smoothed.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (_fifth(id_col) != 0)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    told = known.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    n, toxic = told["n"], told["y"] or 0
    smooth = (toxic + 1) / (n + 2)
    if not toxic or prior == 0:
        return PuModel(Lexicon(np.zeros(0, np.int64)), np.zeros(0), float(np.log(smooth / (1 - smooth))), window)
    prior = min(prior or toxic / n, 0.999)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.col("__id").isNotNull() & (_fifth("__id") != 0))
    count = rows.count()
    draw = lambda seed: F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    chosen = known.where("y = 1").select(F.col(id_col).alias("__id")).where(draw(13) < positives / toxic)
    scratch = Scratch(spark, "toxicity")
    sample = rows.where(draw(31) < unlabelled / max(count, 1)).select("__text", F.lit(0).alias("p")).union(rows.join(F.broadcast(chosen), "__id").select("__text", F.lit(1)))
    sample = scratch.keep(sample, "sample")
    size = {r["p"]: r["count"] for r in sample.groupBy("p").count().collect()}

    def counted(kind: int, among: np.ndarray, name: str) -> DataFrame:
        """(bucket, number of documents of the kind that hold it), of some buckets."""

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from awardgrid.llm.kernels import slices

            held = np.zeros(BUCKETS, np.int64)
            for batch in batches:
                for _, _, data, offs in slices(batch.column("__text")):
                    held += np.bincount(document_buckets(data, offs) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
            on = np.flatnonzero(held * among)
            yield pa.record_batch([pa.array(on), pa.array(held[on])], ["bucket", "n"])

        return sample.where(F.col("p") == kind).mapInArrow(seen, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))

    often = scratch.keep(counted(1, np.ones(BUCKETS, bool), "n_p").where(F.col("n_p") >= least), "often", BUCKETS)
    among = np.zeros(BUCKETS, bool)
    among[often.select("bucket").toArrow().column("bucket").to_numpy()] = True
    in_p, in_u = F.col("n_p") / float(max(size.get(1, 0), 1)), F.coalesce("n_u", F.lit(0)) / float(max(size.get(0, 0), 1))
    both = (F.col("n_p") + F.coalesce("n_u", F.lit(0))) / float(sum(size.values()) or 1)
    far = (in_p - in_u) / F.sqrt(both * (1 - both) * float(1 / max(size.get(1, 0), 1) + 1 / max(size.get(0, 0), 1)) + 1e-12)
    best = often.join(counted(0, among, "n_u"), "bucket", "left").select("bucket", far.alias("far")).where(F.col("far") >= apart).orderBy(F.desc("far"), "bucket").limit(features)
    lexicon = Lexicon(np.sort(np.array([r["bucket"] for r in best.collect()], np.int64)))

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from awardgrid.llm.kernels import slices

        for batch in batches:
            kinds = batch.column("p").to_numpy()
            for lo, hi, data, offs in slices(batch.column("__text")):
                doc, feature, value = lexicon.rates(data, offs, window)
                at = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
                yield pa.record_batch([pa.array(kinds[lo:hi]), *lists], ["p", "f", "v"])

    got = sample.mapInArrow(rates, "p int, f array<int>, v array<float>").toArrow()
    kinds = got.column("p").to_numpy()
    lists = [got.column(c).combine_chunks() for c in "fv"]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    first = lists[0].offsets.to_numpy()
    feature, value = (x.values.to_numpy() for x in lists)
    parts = {y: sorted(((feature[first[i] : first[i + 1]], value[first[i] : first[i + 1]]) for i in np.flatnonzero(kinds == y)), key=lambda r: (r[0].tobytes(), r[1].tobytes())) for y in (0, 1)}
    scratch.drop("sample", "often")
    if not parts[1] or not len(lexicon.buckets):
        return PuModel(Lexicon(np.zeros(0, np.int64)), np.zeros(0), float(np.log(smooth / (1 - smooth))), window)
    if not parts[0]:
        parts[0] = parts[1]
    weights, bias = fit_pu(_Rows(parts[1]), _Rows(parts[0]), len(lexicon.buckets), prior)
    return PuModel(lexicon, weights, bias, window)


def score_toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: PuModel | None = None, **how,
) -> DataFrame:
    """(id, held_out, score, predicted) of every row, whole texts.

    ``score`` is the classifier's chance that the text is toxic; its only input is the text. Labels of rows whose crc32 of the id
    as text, modulo 5, is 0 are never read into the fit (``learn_toxicity``, which ``how`` goes to and
    which bounds its samples). A feature counts by how often it occurs for each ``window`` words, so
    a text of any length is judged as a whole, by its density. Null, empty and letterless texts get the classifier's bias as a score.
    A score of exactly ``threshold`` predicts 1. held_out of a null id is false. Repeated rows are kept, other columns
    ignored whatever their names. An empty table gives no rows. One map over the rows, no shuffle.
    """
    bound_batches(spark)
    fitted = model or learn_toxicity(spark, docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **how)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from awardgrid.llm.kernels import slices

        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("__text")):
                yield pa.record_batch([batch.column("__id").slice(lo, hi - lo), pa.array(fitted.score(data, offs))], ["__id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(judge, f"__id {kind}, score double")
    held = F.coalesce(_fifth("__id") == 0, F.lit(False))
    return scored.select(F.col("__id").alias(id_col), held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
