"""Cost-balanced packing of tokenised documents (operator 3)."""

from __future__ import annotations

import heapq
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm.common import bound_batches

#: Bytes of text in one packing group, about two hundred sequences.
GROUP_BYTES = 3 << 20
CACHE_WORDS = 60_000
_cached: dict[str, "WordTokens"] = {}

#: Latin characters end here; so do those whose lead byte in UTF-8 is at most ``LATIN_LEAD``.
LATIN, LATIN_LEAD = 0x180, 0xC5
_of = lambda kind: re.escape("".join(c for c in map(chr, range(LATIN)) if unicodedata.category(c)[0] == kind))
#: How the tokenizer's own rule splits lower-cased Latin text.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^ \t\n\v\f\r\x85\xa0{_of('L')}{_of('N')}]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Cache(dict):
    """A bounded memory in two generations: what is still in use moves to the new one."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokens:
    """Little-endian 16-bit ids of texts.

    Latin text is lower-cased and split as the tokenizer does it, and its parts go to the
    tokenizer's model. The tokenizer drops white space and never joins across it, so other text is
    cut at ASCII blanks and each run goes through the whole tokenizer. Parts and runs that were met
    before are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = Cache(2 * CACHE_WORDS, self._part)
        self.runs = Cache(CACHE_WORDS, self._run)

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def _run(self, run: bytes) -> bytes:
        ids = self.tokenizer.encode(run.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def encode(self, raw: bytes, offs: np.ndarray) -> list[bytes]:
        """Ids of the texts that ``offs`` cuts out of UTF-8 bytes."""
        data, out = np.frombuffer(raw, np.uint8), []
        foreign = np.concatenate([[0], np.cumsum(data > LATIN_LEAD)])
        part, run = self.parts.__getitem__, self.runs.__getitem__
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            if foreign[a] == foreign[b] and not any(s in (text := raw[a:b].decode()) for s in self.special):
                out.append(b"".join(map(part, _PARTS.findall(text.lower()))))
            else:
                out.append(b"".join(map(run, raw[a:b].split())))
        return out


def _tokens(path: str) -> WordTokens:
    if path not in _cached:
        _cached[path] = WordTokens(path)
    return _cached[path]


def cost(length: np.ndarray | int, linear: float, quadratic: float):
    """Estimated cost of attention over a piece."""
    return linear * length + quadratic * length * length


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document's index, start, length, sequence, offset) of documents given by length.

    Whole sequences are cut off documents that are longer than one. The rest goes, longest first,
    into as few sequences as the tokens need: each to the one of lowest cost among those with room
    left for it; where none has, it fills the roomiest sequences in turn. So only the last tokens of
    a group are padding. Ties go to the sequence with the lower number.
    """
    pieces, rest, at = [], [], 0
    for i, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((i, k * capacity, capacity, at, 0))
            at += 1
        if n % capacity:
            rest.append((n % capacity, i, full * capacity))
    rest.sort(key=lambda r: (-r[0], r[1]))
    bins = -(-sum(r[0] for r in rest) // capacity)
    used, spent = [0] * bins, [0.0] * bins
    cheapest = [(0.0, b) for b in range(bins)]  # a heap by cost; entries that don't match spent are old

    def put(i: int, start: int, n: int, b: int) -> None:
        pieces.append((i, start, n, at + b, used[b]))
        used[b] += n
        spent[b] += cost(n, linear, quadratic)
        if used[b] < capacity:
            heapq.heappush(cheapest, (spent[b], b))

    for n, i, start in rest:
        passed, found = [], None
        while cheapest:
            c, b = heapq.heappop(cheapest)
            if c != spent[b] or used[b] == capacity:
                continue
            if used[b] + n <= capacity:
                found = b
                break
            passed.append((c, b))
        for x in passed:
            heapq.heappush(cheapest, x)
        if found is not None:
            put(i, start, n, found)
            continue
        for b in sorted({b for _, b in passed}, key=lambda b: (used[b], b)):
            part = min(n, capacity - used[b])
            put(i, start, part, b)
            start, n = start + part, n - part
            if not n:
                break
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group long, sequence long, offset long, cost double"


def pack_documents(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    group_bytes: int = GROUP_BYTES,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens, with little padding.

    Documents are dealt to groups of about ``group_bytes`` of text by a hash of their id, their length
    and the input partition they lie in, so a row repeated any number of times is spread like others.
    They are tokenised where they are read, and packed group by group: a group arrives in batches, and
    every ``group_bytes`` of them (four times, to be exact) are packed on their own (see ``pack``), so
    that is what a task holds, whatever the group's size. Each such part leaves less than one sequence
    of padding. The number of groups follows the input's bytes. A piece's ``sequence_id`` is its
    group's number times 2**32 plus the number within the group. ``keep_ids`` adds the pieces' ids as
    an array.

    Null or empty text: the end id alone. Null ids and repeated rows are documents of their own.
    Documents of equal length are packed by id and text. A document of any length is cut. An empty
    table gives no rows. Only the named columns are read, whatever the others are called.
    """
    bound_batches(spark)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from awardgrid.llm.kernels import slices

        words = _tokens(tokenizer)
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                ids = words.encode(data.tobytes(), offs)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("group").slice(lo, hi - lo), pa.array([x + end for x in ids], pa.binary())],
                    ["doc_id", "group", "ids"],
                )

    def part(group: int, held: list[tuple[int | None, bytes]], first: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of some documents in sequences from ``first`` on, and how many those are."""
        held.sort(key=lambda d: (d[0] is None, d[0] or 0, d[1]))
        ids = [np.frombuffer(x, "<u2") for _, x in held]
        of = np.array(pack([len(x) for x in ids], capacity, linear, quadratic), np.int64).reshape(-1, 5)
        cut = [ids[i][s : s + n] for i, s, n, _, _ in of.tolist()]
        length = of[:, 2]
        columns = {
            "doc_id": pa.array([held[i][0] for i in of[:, 0]], pa.int64()),
            "start": of[:, 1], "length": length,
            "ids_crc32": np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], np.int64),
            "doc_tokens": np.array([len(ids[i]) for i in of[:, 0]], np.int64),
            "group": np.full(len(of), group, np.int64), "sequence": of[:, 3] + first, "offset": of[:, 4],
            "cost": cost(length.astype(float), linear, quadratic),
        }
        if keep_ids:
            columns["ids"] = pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
        made = pa.record_batch({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})
        return made, int(of[:, 3].max()) + 1

    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, size = key[0].as_py(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        for batch in batches:
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                held.append((name, x.as_py()))
                size += len(held[-1][1]) + 32
                if size > 4 * group_bytes:
                    made, n = part(group, held, first)
                    first, size, held = first + n, 0, []
                    yield made
        if held:
            yield part(group, held, first)[0]

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text_col), F.spark_partition_id()), F.lit(groups)).alias("group"),
        F.col(text_col).alias("text"),
    )
    packed = (
        rows.mapInArrow(encode, "doc_id long, group long, ids binary")
        .groupBy("group")
        .applyInArrow(fill, SCHEMA + (", ids array<int>" if keep_ids else ""))
    )
    sequence = (F.col("group") * (1 << 32) + F.col("sequence")).alias("sequence_id")
    return packed.select(
        F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", sequence, "offset", "cost", *["ids"] * keep_ids
    )
