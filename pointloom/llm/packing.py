"""Packing documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import codec, pieces, read_ranks
from .common import as_bytes, stored

#: The remainder length under which a task's count of whole pieces is filed.
WHOLE = -1


def best_pattern(value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: copies of each length 1..size whose total fits size and whose value is greatest.

    value[n] is what a piece of length n is worth (-inf: there is none).
    """
    best = np.zeros(size + 1)
    taken = np.zeros(size + 1, np.int64)
    for w in range(1, size + 1):
        each = best[w - 1 :: -1] + value[1 : w + 1] if w > 1 else best[:1] + value[1:2]
        k = int(each.argmax())
        if each[k] > best[w - 1]:
            best[w], taken[w] = each[k], k + 1
        else:
            best[w] = best[w - 1]
    copies = np.zeros(size + 1, np.int64)
    w = size
    while w > 0:
        if taken[w]:
            copies[taken[w]] += 1
            w -= taken[w]
        else:
            w -= 1
    return float(best[size]), copies


def full_patterns(lengths: list[int], demand: np.ndarray, size: int) -> list[dict[int, int]]:
    """Patterns to start from: each takes the longest length left and fills up with the longest that fit.

    It is used until one of its lengths is spent, so there are as many as lengths at most.
    """
    left = {n: float(d) for n, d in zip(lengths, demand)}
    patterns: list[dict[int, int]] = []
    open_ = list(lengths)  # ascending
    while open_:
        pattern: dict[int, int] = {}
        room, k = size, len(open_)
        while room and (k := bisect_right(open_, room, 0, k)):
            k -= 1
            n = open_[k]
            pattern[n] = max(1, min(room // n, int(left[n]))) if pattern else 1
            room -= n * pattern[n]
        turns = min(left[n] / c for n, c in pattern.items())
        for n, c in pattern.items():
            left[n] -= turns * c
        patterns.append(pattern)
        open_ = [n for n in open_ if left[n] > 1e-9]
    return patterns


def column_generation(demand: dict[int, int], size: int, rounds: int = 200, gap: float = 1e-4) -> list[tuple[dict[int, int], float]]:
    """Fractional use of patterns that cover the demand of every length exactly.

    The linear program has a row for each length below size that occurs (size - 1 at most,
    however many documents there are). It starts from one pattern
    for each length; the simplex method takes in first full_patterns, then what
    best_pattern finds when it prices columns by the duals. It ends when pricing shows that
    no column improves, or when the tokens or Farley's bound show that the rest of the way
    is at most gap of the sequences. rounds bounds the priced columns: the result is valid at any time, and what
    its patterns don't hold is packed too (make_plan).
    """
    lengths = np.array(sorted(n for n, d in demand.items() if d > 0 and 0 < n < size), np.int64)
    m = len(lengths)
    if not m:
        return []
    d = np.array([demand[n] for n in lengths.tolist()], float)
    copies = size // lengths
    columns = [{int(n): int(c)} for n, c in zip(lengths, copies)]
    matrix = np.diag(copies.astype(float))
    inverse, x = np.diag(1.0 / copies), d / copies
    at = {n: i for i, n in enumerate(lengths.tolist())}
    ready = np.zeros((m, m))
    for j, pattern in enumerate(full_patterns(lengths.tolist(), d, size)):
        for n, c in pattern.items():
            ready[at[n], j] = c
    least = float(lengths @ d) / size
    priced = 0
    for turn in range(3 * m + rounds):
        if x.sum() <= least * (1 + gap) or priced >= rounds:
            break
        if turn and turn % 400 == 0:  # take away rounding errors
            inverse = np.linalg.inv(matrix)
            x = np.maximum(inverse @ d, 0)
        duals = inverse.sum(axis=0)
        gains = duals @ ready
        j = int(gains.argmax())
        if gains[j] > 1 + 1e-7:
            entering = ready[:, j].copy()
        else:
            worth = np.full(size + 1, -np.inf)
            worth[lengths] = duals
            value, pattern = best_pattern(worth, size)
            priced += 1
            if value <= 1 + 1e-9 or 1 - 1 / value <= gap:  # Farley: x.sum() / value is a lower bound
                break
            entering = pattern[lengths].astype(float)
        change = inverse @ entering
        steps = np.where(change > 1e-9, x / np.maximum(change, 1e-9), np.inf)
        out = int(steps.argmin())
        if not np.isfinite(steps[out]):
            break
        x = np.maximum(x - steps[out] * change, 0)
        x[out] = steps[out]
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        matrix[:, out] = entering
        columns[out] = {int(n): int(c) for n, c in zip(lengths, entering) if c}
    return [(c, float(v)) for c, v in zip(columns, x)]


@dataclass
class Plan:
    """Where the remainder of rank r among those of its length goes; its size depends on the sequence length only."""

    size: int
    slots: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)  # length: (first rank, copies, first sequence, offset)
    packed: dict[int, int] = field(default_factory=dict)  # length: remainders that patterns take
    rest: dict[int, int] = field(default_factory=dict)  # length: where its first other remainder starts in the stream of the rest
    full: int = 0  # full sequences of the stream
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where its end is cut
    first_rest: int = 0
    first_whole: int = 0

    def place(self, n: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of the remainder, in order."""
        if rank < self.packed.get(n, 0):
            spans = self.slots[n]
            k = len(spans) - 1
            while spans[k][0] > rank:
                k -= 1
            first, copies, sequence, offset = spans[k]
            turn, slot = divmod(rank - first, copies)
            return [(sequence + turn, offset + slot * n, n)]
        at = self.rest[n] + (rank - self.packed.get(n, 0)) * n
        end, out = at + n, []
        while at < end:
            if at < self.full * self.size:
                k, offset = divmod(at, self.size)
                upto = min(end, (k + 1) * self.size)
            else:
                own = at - self.full * self.size
                j = int(np.searchsorted(self.cuts, own, "right")) - 1
                k, offset = self.full + j, own - int(self.cuts[j])
                upto = min(end, at - own + int(self.cuts[j + 1]))
            out.append((self.first_rest + k, offset, upto - at))
            at = upto
        return out


def make_plan(demand: dict[int, int], size: int, rounds: int = 200, gap: float = 1e-4) -> Plan:
    """Round the patterns down; what is left over forms one stream, cut where a sequence is full.

    Patterns that leave room in a sequence are not used either: what they would hold goes
    to the stream, so that nothing is padded. The end of the stream, shorter than a
    sequence, is cut into powers of two.
    """
    plan = Plan(size)
    sequences = 0
    for pattern, use in sorted(column_generation(demand, size, rounds, gap), key=lambda x: -x[1]):
        turns = int(use + 1e-6)
        turns = min([turns, *((demand[n] - plan.packed.get(n, 0)) // c for n, c in pattern.items())])
        if turns <= 0 or sum(n * c for n, c in pattern.items()) < size:
            continue
        offset = 0
        for n, copies in sorted(pattern.items(), reverse=True):
            first = plan.packed.get(n, 0)
            plan.slots.setdefault(n, []).append((first, copies, sequences, offset))
            plan.packed[n] = first + copies * turns
            offset += n * copies
        sequences += turns
    total = 0
    for n in sorted(demand, reverse=True):
        plan.rest[n] = total
        total += n * (demand[n] - plan.packed.get(n, 0))
    plan.full, tail = divmod(total, size)
    cuts = [0]
    for bit in range(size.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    plan.cuts = np.array(cuts, np.int64)
    plan.first_rest = sequences
    plan.first_whole = sequences + plan.full + len(cuts) - 1
    return plan


_encoders: dict[str, object] = {}


def encoder(ranks_path: str, pattern: str, special: dict[str, int]):
    """ids as tokenizers gives them for the same vocabulary, from the faster library (tests compare the two).

    Texts on which that library fails (its regex overflows on runs of about a million spaces) go to the codec of bpe.
    """
    import tiktoken

    key = f"{ranks_path}\0{pattern}\0{special}"
    if key not in _encoders:
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens=special)

        def encode_slowly(text: str) -> list[int]:
            parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if special else [text]
            own = codec(ranks_path, pattern)
            return [i for x in parts for i in ([special[x]] if x in special else np.frombuffer(own.encode_all([x])[0], "<u4").tolist())]

        def encode(text: str) -> list[int]:
            try:
                if any(word in text for word in special):
                    return encoding.encode(text, allowed_special="all")
                return encoding.encode_ordinary(text)
            except BaseException as error:  # a panic is no Exception
                if not isinstance(error, Exception) and type(error).__name__ != "PanicException":
                    raise
                return encode_slowly(text)

        _encoders[key] = encode
    return _encoders[key]


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    special: dict[str, int],
    size: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    rounds: int = 200,
    gap: float = 1e-4,
) -> DataFrame:
    """Pack all documents, each with end_id after it, into sequences of at most size tokens.

    A row per piece: id, start (the document's tokens before it), length, ids_crc32,
    doc_tokens, sequence_id, offset (in the sequence); with_ids also ids (binary,
    little-endian unsigned 32 bits). A document's whole multiples of size are sequences of
    their own; its remainder goes where the plan puts the remainder of its length and rank.

    Null or empty text is the empty document (one token). Null ids and repeated rows are
    packed like any other row. Other columns are ignored; an empty table gives no rows.

    The plan needs the histogram of remainder lengths (size - 1 counts) and is at most
    about size * size numbers, whatever the input. Ranks come from each task's own counts
    and the sums over earlier tasks, so a length that a third of the documents share is
    dealt over as many keys as there are tasks. Token ids are stored once, in the folder
    that all executors share: tasks that are run again read the same ranks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern, special)
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        wholes = 0
        for batch in batches:
            raw = as_bytes(batch.column(1))
            for part in pieces(raw):
                out: list[list] = [[] for _ in range(6)]
                for text in raw[part]:
                    ids = np.array(encode(text.decode()) + [end_id], "<u4")
                    whole, n = divmod(len(ids), size)
                    out[0].append(len(ids))
                    out[1].append(wholes)
                    out[2].append(ids[: whole * size].tobytes() if with_ids else np.array([zlib.crc32(ids[i * size : (i + 1) * size].tobytes()) for i in range(whole)], "<u4").tobytes())
                    out[3].append(n)
                    out[4].append(ranks.get(n, 0))
                    out[5].append(ids[whole * size :].astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 65536 else ids[whole * size :].tobytes())
                    ranks[n] = ranks.get(n, 0) + 1
                    wholes += whole
                rows = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop],
                        pa.array(np.full(rows, task, np.int32)),
                        pa.array(out[0], pa.int64()),
                        pa.array(out[1], pa.int64()),
                        pa.array(out[2], pa.binary()),
                        pa.array(out[3], pa.int32()),
                        pa.array(out[4], pa.int64()),
                        pa.array(out[5], pa.binary()),
                    ],
                    ["id_", "task_", "tokens_", "whole_", "wholes_", "n_", "rank_", "rest_"],
                )

    schema = f"id_ {kind}, task_ int, tokens_ bigint, whole_ bigint, wholes_ binary, n_ int, rank_ bigint, rest_ binary"
    tokens = stored(docs.select(docs[id_col].alias("id_"), docs[text_col].cast("string").alias("text_")).mapInArrow(tokenize, schema), "tokens")

    counts = tokens.groupBy("task_", "n_").agg(F.count("*").alias("rows_"), F.sum(F.floor(F.col("tokens_") / size)).alias("wholes_"))
    counts = stored(counts, "counts")
    demand = {r["n_"]: r["rows_"] for r in counts.filter("n_ > 0").groupBy("n_").agg(F.sum("rows_").alias("rows_")).collect()}
    plan = make_plan(demand, size, rounds, gap)

    before = lambda *keys: Window.partitionBy(*keys).orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("rank_before_", F.coalesce(F.sum("rows_").over(before("n_")), F.lit(0))).select("task_", "n_", "rank_before_")
    wholes = counts.groupBy("task_").agg(F.sum("wholes_").alias("wholes_"))
    wholes = wholes.withColumn("whole_before_", F.coalesce(F.sum("wholes_").over(before()), F.lit(0))).select("task_", "whole_before_")
    placed = tokens.join(ranks.join(wholes, "task_"), ["task_", "n_"])

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out_schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            got = [col[x].to_pylist() for x in ("tokens_", "whole_", "wholes_", "n_", "rank_", "rest_", "rank_before_", "whole_before_")]
            source: list[int] = []
            out: list[list] = [[] for _ in names[1:]]
            blobs: list[bytes] = []

            def add(i, start, n, crc, total, sequence, offset, ids):
                source.append(i)
                for c, x in zip(out, (start, n, crc, total, sequence, offset)):
                    c.append(x)
                blobs.append(ids)

            for i, (total, whole, wholes_, n, rank, rest, rank0, whole0) in enumerate(zip(*got)):
                for k in range(total // size):
                    ids = wholes_[k * size * 4 : (k + 1) * size * 4] if with_ids else b""
                    crc = zlib.crc32(ids) if with_ids else int.from_bytes(wholes_[4 * k : 4 * k + 4], "little")
                    add(i, k * size, size, crc, total, plan.first_whole + whole0 + whole + k, 0, ids)
                if n:
                    ids = np.frombuffer(rest, "<u2" if len(rest) == 2 * n else "<u4").astype("<u4").tobytes()
                    start = total - n
                    at = 0
                    for sequence, offset, length in plan.place(n, rank0 + rank):
                        piece = ids[4 * at : 4 * (at + length)]
                        add(i, start + at, length, zlib.crc32(piece), total, sequence, offset, piece)
                        at += length
            arrays = [batch.column(batch.schema.names.index("id_")).take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in out)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(blobs, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return placed.mapInArrow(cut, out_schema)
