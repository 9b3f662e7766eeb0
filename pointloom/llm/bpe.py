"""Byte-level BPE by corpus-level merge replay."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class MergeReplay:
    """Encodes the distinct words of a corpus slice together.

    All words stand in one array of symbols with links to both neighbours. An inverted
    index maps each token pair's rank to the positions where the pair stands in any word.
    A heap yields the ranks in order; the merge of a rank is replayed at all its positions
    at once, but in a word only up to the first merge that brings up a pair of a lower
    rank, which then comes first. A merge touches only
    its two neighbours, whose pairs are looked up anew. Index entries that no longer hold
    are skipped when their rank comes. Words of any length take this path.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        codes, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a = ranks.get(token[:k])
                if a is not None and (b := ranks.get(token[k:])) is not None:
                    codes.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(codes, np.int64))
        self.codes, self.merged = np.array(codes, np.int64)[order], np.array(merged, np.int32)[order]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b), NONE where the two don't merge."""
        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.merged[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        joined = b"".join(words)
        n = len(joined)
        if not n:
            return [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        symbol = np.append(self.single[np.frombuffer(joined, np.uint8)], self.single[:1])
        # position n is a stand-in for "no neighbour", also in symbol
        right = np.arange(1, n + 2)
        left = np.arange(-1, n)
        last = ends[lengths > 0] - 1
        first = (ends - lengths)[lengths > 0]
        right[last], left[first] = n, n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        pair = np.full(n + 1, self.NONE, np.int32)
        inner = np.flatnonzero(right[:n] < n)
        pair[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def file(spots: np.ndarray, ranks: np.ndarray) -> None:
            good = ranks != self.NONE
            spots, ranks = spots[good], ranks[good]
            if not len(spots):
                return
            order = np.argsort(ranks, kind="stable")
            spots, ranks = spots[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, group in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(spots, cuts)):
                if rank in index:
                    index[rank].append(group)
                else:
                    index[rank] = [group]
                    heappush(waiting, rank)

        file(inner, pair[inner])
        while waiting:
            rank = heappop(waiting)
            groups = index.pop(rank)
            spots = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            every = spots = spots[(pair[spots] == rank) & alive[spots]]
            if not len(spots):
                continue
            gone, at = right[spots], np.arange(len(spots))
            # of pairs that share a symbol every other one, from the left
            lead = np.ones(len(spots), bool)
            lead[1:] = gone[:-1] != spots[1:]
            odd = (at - np.maximum.accumulate(np.where(lead, at, 0))) % 2 == 1
            spots, gone = spots[~odd], gone[~odd]
            before, after, own = left[spots], right[gone], word[spots]
            # the pairs that each merge brings up, when those to its left are done
            beside = symbol[before]
            beside[1:][before[1:] == gone[:-1]] = rank
            fresh = np.full(len(spots), rank, np.int32)
            low = (before < n) & (self._ranks(beside, fresh) < rank) | (after < n) & (self._ranks(fresh, symbol[after]) < rank)
            if low.any():
                lows = np.cumsum(low) - low
                first = np.ones(len(spots), bool)
                first[1:] = own[1:] != own[:-1]
                go = lows == np.maximum.accumulate(np.where(first, lows, 0))
                spots, gone, after = spots[go], gone[go], after[go]
            if len(spots) < len(every):
                index[rank] = [every]
                heappush(waiting, rank)
            symbol[spots] = rank
            alive[gone] = False
            right[spots] = after
            left[after] = spots  # writes to the stand-in do no harm
            pair[spots] = self.NONE
            at = spots[after < n]
            back = left[spots]
            touched = np.unique(np.concatenate((back[back < n], at)))
            pair[touched] = self._ranks(symbol[touched], symbol[right[touched]])
            file(touched, pair[touched])
        kept = np.flatnonzero(alive[:n])
        ids = symbol[kept].astype("<u4").tobytes()
        upto = np.searchsorted(kept, ends) * 4
        return [ids[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]


class Codec:
    """Words to ids through MergeReplay with a bounded memory of words seen before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 800_000, keep_bytes: int = 64):
        import regex

        self.find = regex.compile(pattern).findall
        self.replay = MergeReplay(ranks)
        self.tokens = self.replay.tokens
        self.known: dict[str, bytes] = {}
        self.keep, self.keep_bytes = keep, keep_bytes

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(text) for text in texts]
        known = self.known
        fresh = list({w: None for words in split for w in words if w not in known})
        made = dict(zip(fresh, self.replay.encode([w.encode() for w in fresh])))
        known.update(made)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > self.keep_bytes:
                del known[w]
        if len(known) > self.keep:
            for w in list(islice(known, len(known) - self.keep)):
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(path), pattern)
    return _codecs[key]


def pieces(texts: list[bytes], size: int = 4_000_000) -> Iterator[slice]:
    """Slices of the batch of about size bytes: the scratch space of a slice is bounded by it or by one text."""
    first = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield slice(first, i + 1)
            first, total = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def encode_decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode every whole text, decode the ids again, return digests (and the ids if asked).

    A row per input row: the id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids
    (binary, little-endian unsigned 32 bits). Null or empty text: no tokens, digests of
    nothing. Null ids and repeated rows pass through. Other columns are ignored. There is
    no shuffle: words are replayed once for each worker's slice of the corpus.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in batches:
            raw = as_bytes(batch.column(1))
            for part in pieces(raw, 8_000_000):
                ids = code.encode_all([t.decode() for t in raw[part]])
                columns = [
                    batch.column(0)[part.start : part.stop],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(code.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, docs[text_col].cast("string").alias("text_")).mapInArrow(run, schema)
