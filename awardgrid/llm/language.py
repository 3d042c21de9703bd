"""Language identification by rank-order n-gram profiles (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from awardgrid.llm.common import bound_batches

#: Bytes that the n-grams see: lower-case ASCII letters and all bytes of other characters; the rest is one blank.
_MAP = np.zeros(256, np.uint8)
_MAP[0x61:0x7B] = np.arange(1, 27)
_MAP[0x41:0x5B] = np.arange(1, 27)
_MAP[0x80:] = np.arange(27, 155)
PROFILE = 400
#: More languages than the driver can hold profiles of raise an error.
MOST_LANGUAGES = 20_000


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all runs of one to three letters (bytes); blanks mark the ends of words."""
    x = _MAP[data].astype(np.uint32)
    if len(x):
        blank = x == 0
        x = x[~(blank & np.concatenate([[False], blank[:-1]]))]
    x = np.concatenate([[0], x, [0]]).astype(np.uint32)
    two = x[:-1] << 8 | x[1:]
    three = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    inner = three[(three >> 8 & 255) != 0]
    two = two[two & 255 != 0] | (1 << 24)
    one = x[x != 0] | (1 << 25)
    return np.unique(np.concatenate([one, two, inner]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes, most frequent first, equal counts by code."""
    if len(codes) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:n]


class Profiles:
    """For each language the rank of its most frequent n-grams."""

    def __init__(self, ranks: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(ranks), size
        self.codes = np.unique(np.concatenate([*ranks.values(), np.zeros(0, np.uint32)])).astype(np.uint32)
        self.rank = np.full((len(self.langs), len(self.codes) + 1), size, np.int32)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, ranks[lang])] = np.arange(len(ranks[lang]))

    def predict(self, data: np.ndarray) -> tuple[str, float]:
        """The language with the least out-of-place distance, and how far the next one is behind (0 to 1)."""
        doc = ranked(*grams(data), self.size)
        if not len(doc) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, doc)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != doc)] = len(self.codes)
        ranks = self.rank[:, at]
        far = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(doc)))).sum(1)
        best = int(np.argmin(far))
        if len(far) == 1:
            return self.langs[0], float(1 - far[0] / (self.size * len(doc)))
        second = np.partition(far, 1)[1]
        return self.langs[best], float((second - far[best]) / second) if second else 0.0


def fit_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000, size: int = PROFILE) -> Profiles:
    """Profiles of the languages of about ``sample`` learning rows, those with the least hashes of their id.

    Learning rows: text and language are not null and crc32 of the id as text, modulo 4, is not 2.
    Each learned language has an equal share of ``sample``, 20 rows at least, so a rare language has a
    profile too; over ``MOST_LANGUAGES`` of them raise. n-gram counts are summed where the rows are.
    Equal counts are ranked by the n-gram's code. An empty table gives no profile.
    """
    rows = docs.where(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
        & (F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2)
    ).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit(9)).alias("h"))
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    if not counts:
        return Profiles({}, size)
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], max(20.0, sample / len(counts)) / r["count"]) for r in counts], "lang string, share double")
    picked = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 52)) < F.col("share") * float(1 << 52))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from awardgrid.llm.kernels import slices

        sums: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                langs = batch.column("lang").slice(lo, hi - lo).to_pylist()
                for lang, a, b in zip(langs, offs[:-1], offs[1:], strict=True):
                    own = sums.setdefault(lang, {})
                    for c, n in zip(*(x.tolist() for x in grams(data[a:b])), strict=True):
                        own[c] = own.get(c, 0) + n
        for lang, own in sums.items():
            yield pa.record_batch([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "code", "n"])

    sums = picked.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranks: dict[str, list[int]] = {}
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    for r in sums.withColumn("r", nth).where(F.col("r") <= size).orderBy("lang", "r").collect():
        ranks.setdefault(r["lang"], []).append(r["code"])
    return Profiles({k: np.array(v, np.uint32) for k, v in ranks.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, lang_pred, score, and the columns in ``keep``) of every row; whole texts are read.

    A document's n-grams are ranked by frequency and compared with each profile: the distance sums
    how far each is out of place, ``PROFILE`` where the profile lacks it. ``score`` is the lead of
    the nearest profile over the next as a share of the latter's distance; of languages at equal
    distance the first by name wins, with score 0. Null text, empty text or text without a letter:
    ``und`` with score 0. A text of any length is read whole, one at a time. An empty table gives no
    rows. Columns in ``keep`` may have any names, those used inside included. Without any learning row every document is ``und``.
    held_out of a null id is false. Repeated rows are kept. One map over the rows, no shuffle.
    """
    bound_batches(docs.sparkSession)
    schema = docs.select(F.col(id_col), *keep).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from awardgrid.llm.kernels import slices

        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("__text"), 4 << 20):
                found = []
                for a, b in zip(offs[:-1], offs[1:], strict=True):
                    own = data[a:b]
                    found.append(profiles.predict(own) if has_letter(own) else ("und", 0.0))
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch(
                    [*[part.column(c) for c in names], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    [*names, "lang_pred", "score"],
                )

    names = [f"c{i}" for i in range(len(schema))]
    plain = docs.select(*[F.col(f.name).alias(n) for n, f in zip(names, schema, strict=True)], F.col(text_col).alias("__text"))
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema, strict=True))
    out = plain.mapInArrow(predict, f"{kinds}, lang_pred string, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("c0").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return out.select(F.col("c0").alias(id_col), held.alias("held_out"), "lang_pred", "score", *[F.col(n).alias(f.name) for n, f in list(zip(names, schema, strict=True))[1:]])


def has_letter(data: np.ndarray) -> bool:
    """An ASCII letter, or else any letter in the text as Unicode has it."""
    if ((data | 0x20) - np.uint8(0x61) < 26).any():
        return True
    return bool((data >= 0x80).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def predict_languages(spark: SparkSession, docs: DataFrame, sample: int = 4000, **names: str) -> DataFrame:
    """Fit on the learning rows of ``docs`` and predict all of them."""
    return identify(docs, fit_profiles(docs, sample=sample, **names), **{k: v for k, v in names.items() if k != "lang_col"})
