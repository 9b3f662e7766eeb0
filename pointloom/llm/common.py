"""Helpers that the corpus operators share: work folders and word hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import work_dir

#: White space of every word rule: space, tab, line feed, vertical tab, form feed, return.
SPACES = b" \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df below the shared folder and read it back: this cuts the lineage."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Here Spark removes a query's shuffle files when the query ends, not when the driver's memory is tidied.

    Tables built here should be read here, once: a later read would make its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_TAIL = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of raw on, which must end in eight bytes of padding."""
    return np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))


class Words:
    """The words of some texts: joined with one space after each, where each starts and ends, how many each text has.

    Words are runs of anything but the six white-space bytes; lower maps A-Z only. The
    scratch space is a few times the texts.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        word = ~_IS_SPACE[raw]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        begin, length = edge[::2], edge[1::2] - edge[::2]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.counts = np.diff(np.searchsorted(begin, ends), prepend=0) if len(texts) else np.zeros(0, np.int64)
        keep = word.copy()
        keep[edge[1::2]] = True  # the byte after each word
        bare = np.zeros(int(length.sum()) + len(length) + 8, np.uint8)
        bare[:-8] = raw[keep]
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        bare[self.end] = 32
        self.raw = bare

    def hashes(self, salt: int = 0, some: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of all words, or of those numbered in some: eight bytes at a time, each folded in by mix."""
        start, end = (self.start, self.end) if some is None else (self.start[some], self.end[some])
        length, eights = end - start, _eights(self.raw)
        h = mix((length.astype(np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15))
        short = np.arange(len(start)) if not (length > _LONG).any() else np.flatnonzero(length <= _LONG)
        at = 0
        while len(short):
            left = length[short] - at
            h[short] = mix(h[short] ^ (eights[start[short] + at] & _TAIL[np.minimum(left, 8)]))
            at += 8
            short = short[left > 8]
        for i in np.flatnonzero(length > _LONG).tolist():
            digest = hashlib.blake2b(self.raw[start[i] : end[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest()
            h[i] = np.frombuffer(digest, "<u8")[0]
        return h

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all windows of width words that lie in one text, and the numbers of their texts."""
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        n = len(text) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.flatnonzero(text[:n] == text[width - 1 :])
        return start, text[start]

    def span(self, first: int, end: int) -> bytes:
        """Words first to end, joined by spaces."""
        return self.raw[self.start[first] : self.end[end - 1]].tobytes() if end > first else b""


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def same_words(one: Words, a: np.ndarray, two: Words, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the width words from a on of one are those from b on of two, pair by pair and byte by byte."""
    at, to = one.start[a], two.start[b]
    length = one.end[a + width - 1] - at
    same = length == two.end[b + width - 1] - to
    left, right = _eights(one.raw), _eights(two.raw)
    some, k = np.flatnonzero(same), 0
    while len(some):
        if k == 4096:  # few and very long
            for i in some.tolist():
                same[i] = bytes(one.raw[at[i] : at[i] + length[i]]) == bytes(two.raw[to[i] : to[i] + length[i]])
            break
        rest = length[some] - k
        same[some] = ((left[at[some] + k] ^ right[to[some] + k]) & _TAIL[np.minimum(rest, 8)]) == 0
        some = some[same[some] & (rest > 8)]
        k += 8
    return same


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the windows of width word hashes from each start on; every word changes the hash."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[k : k + n]
    return mix(h)[starts]


def as_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """Whole rows of about size bytes of text at a time, over batch limits: the columns before the last, which is text."""
    columns: list[list] = []
    texts: list[bytes] = []
    total = 0
    for batch in batches:
        raw = as_bytes(batch.column(batch.num_columns - 1))
        others = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
        first = 0
        for i, text in enumerate(raw):
            total += len(text) + 1
            if total >= size or i == len(raw) - 1:
                columns.append([c[first : i + 1] for c in others])
                texts += raw[first : i + 1]
                first = i + 1
            if total >= size:
                yield [np.concatenate(c) for c in zip(*columns)], texts
                columns, texts, total = [], [], 0
    if texts:
        yield [np.concatenate(c) for c in zip(*columns)], texts


def buckets_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """Keys 0 to buckets - 1; bucket_column says the same of a column."""
    return ((numbers ^ (numbers >> np.int64(9))) % buckets + buckets) % buckets


def bucket_column(number: Column, buckets: int) -> Column:
    return F.pmod(number.bitwiseXOR(F.shiftright(number, 9)), F.lit(buckets).cast("long"))


def pack_runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end, in arrays that are sorted by them."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n)


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, as differences: sorted or equal ones compress well."""
    return np.diff(numbers.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel())
