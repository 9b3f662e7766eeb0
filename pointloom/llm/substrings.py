"""Removal of repeated passages by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Words, bucket_column, buckets_of, chunks, from_planes, pack_runs, planes, same_words, shuffle_width, stored, window_hashes

#: Bits of a word in the path code of a suffix, and words in the code.
BITS, DEPTH = 12, 5
#: What a packed row says of its suffixes: a leaf to sort into a group; a repeat that was compared word by
#: word; one below a node that the group found; paths that lie on several nodes; a repeat given by its words.
LEAF, SURE, TIED, MIXED, SPELT = range(5)


def path_codes(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The first depth words of each suffix, BITS of a word's hash each, as one integer: a path from the root."""
    code = np.zeros(len(starts), np.int64)
    short = (words >> np.uint64(64 - BITS)).astype(np.int64)
    for k in range(depth):
        code = code << BITS | short[starts + k]
    return code


def _light_runs(codes: list[int], sizes: list[int], most: int, deeper: bool) -> list[tuple[int, int, bool]]:
    """Neighbours joined as long as they hold at most most together: (first code, suffixes, whether to go deeper)."""
    out: list[tuple[int, int, bool]] = []
    for code, n in zip(codes, sizes):
        if n > most and deeper:
            out.append((code, n, True))
        elif out and not out[-1][2] and out[-1][1] + n <= most:
            out[-1] = (out[-1][0], out[-1][1] + n, False)
        else:
            out.append((code, n, False))
    return out


def _runs(most: int, deeper: bool):
    def runs(table: pa.Table) -> pa.Table:
        prefix = table.column("prefix")[0].as_py()
        sizes = np.sum([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()], axis=0)
        some = np.flatnonzero(sizes)
        found = _light_runs(((prefix << BITS) + some).tolist(), sizes[some].tolist(), most, deeper)
        return pa.table({"code": pa.array([x[0] for x in found], pa.int64()), "n": pa.array([x[1] for x in found], pa.int64()), "deeper": pa.array([x[2] for x in found], pa.bool_())})

    return runs


def prefix_groups(texts: DataFrame, width: int, most: int | None, chunk: int) -> tuple[np.ndarray, int]:
    """Bounds of the groups in the order of path codes, and the number of suffixes.

    texts has one column of text. All suffixes are counted by their first word; only the prefixes that hold more than
    most suffixes are counted again one word deeper, up to DEPTH words. Neighbouring
    prefixes share a group as long as it stays within most. A task sends one vector of
    counts for each prefix that it splits; vectors are added up in two steps, 512 tasks at
    a time. The driver gets the runs of light children, of which there are about
    2 * suffixes / most: 8 bytes for each group.
    """
    depth = min(DEPTH, width)
    ranges: list[tuple[int, int]] = []  # first code, suffixes
    total = 0
    heavy = [0]
    for level in range(1, depth + 1):
        parents = np.array(sorted(heavy), np.int64)

        def count(batches, level=level, parents=parents):
            sums = np.zeros((len(parents), 1 << BITS), np.int64)
            for _, raw in chunks(batches, chunk):
                words = Words(raw)
                starts, _ = words.windows(width)
                code = path_codes(words.hashes(), starts, level)
                at = np.minimum(np.searchsorted(parents, code >> BITS), len(parents) - 1)
                ours = parents[at] == code >> BITS
                sums += np.bincount((at[ours] << BITS) + (code[ours] & (1 << BITS) - 1), minlength=sums.size).reshape(sums.shape)
            used = np.flatnonzero(sums.any(axis=1))
            task = TaskContext.get().partitionId() // 512
            yield from _vectors(parents[used], np.full(len(used), task), sums[used]).to_batches()

        def add_up(table: pa.Table) -> pa.Table:
            vectors = [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()]
            return _vectors(table.column("prefix").to_numpy()[:1], table.column("part").to_numpy()[:1], np.sum(vectors, axis=0)[None])

        vectors = texts.mapInArrow(count, _VECTORS).groupBy("prefix", "part").applyInArrow(add_up, _VECTORS)
        rows = vectors.groupBy("prefix").applyInArrow(_runs(most or 0, level < depth), "code bigint, n bigint, deeper boolean").collect()
        found = sorted((r["code"], r["n"], r["deeper"]) for r in rows)
        if level == 1 and not most:  # every child came back, as nothing is light yet
            total = sum(n for _, n, _ in found)
            most = max(1 << 14, min(1 << 23, total // (4 * shuffle_width(texts.sparkSession))))
            found = _light_runs([c for c, _, _ in found], [n for _, n, _ in found], most, level < depth)
        total = total or sum(n for _, n, _ in found)
        ranges += [(code << BITS * (depth - level), n) for code, n, deeper in found if not deeper]
        heavy = [code for code, _, deeper in found if deeper]
        if not heavy:
            break
    bounds, size = [0], 0
    for code, n in sorted(ranges):
        if size and size + n > most:
            bounds.append(code)
            size = 0
        size += n
    return np.array(bounds, np.int64), total


_VECTORS = "prefix bigint, part bigint, counts binary"


def _vectors(prefixes: np.ndarray, parts: np.ndarray, sums: np.ndarray) -> pa.Table:
    return pa.table({"prefix": pa.array(prefixes, pa.int64()), "part": pa.array(parts, pa.int64()), "counts": pa.array([x.astype(np.int64).tobytes() for x in sums], pa.binary())})


#: A row holds suffixes of one key, kind and side (documents with or without id): the distinct documents,
#: how many paths each has, the paths in 4 and 2 bytes, and the other end of each or its words.
_PACKED = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("nul", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("refs", pa.binary()), ("spelt", pa.list_(pa.binary()))])
_PACKED_SQL = "key bigint, kind int, nul boolean, ids binary, counts binary, low binary, high binary, refs binary, spelt array<binary>"


def _pack(kind: int, keys: np.ndarray, nul: np.ndarray, ids: np.ndarray, paths: np.ndarray, refs: np.ndarray | None = None, spelt: list[bytes] | None = None) -> pa.Table:
    order = np.lexsort((paths, *(() if refs is None else (refs,)), ids, nul, keys))  # equal refs side by side: they compress
    keys, nul, ids, paths = keys[order], nul[order], ids[order], paths[order]
    rows = []
    for a, b in zip(*(x.tolist() for x in pack_runs(keys, nul))):
        first, end = pack_runs(ids[a:b])
        own = paths[a:b]
        rows.append(
            (
                int(keys[a]), kind, bool(nul[a]), planes(ids[a:b][first]), (end - first).astype("<u4").tobytes(),
                own.astype("<u4").tobytes(), (own >> np.uint64(32)).astype("<u2").tobytes(),
                b"" if refs is None else planes(refs[order[a:b]]), [] if spelt is None else [spelt[i] for i in order[a:b]],
            )
        )
    columns = zip(*rows) if rows else [[]] * len(_PACKED)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


def _unpack(table: pa.Table, *kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """nul, ids, paths, refs (of TIED rows), words (of SPELT rows) of the rows of the kinds."""
    table = table.filter(pc.is_in(table.column("kind"), pa.array(kinds, pa.int32())))

    def joined(name, kind):
        parts = [np.frombuffer(x, kind) if kind != np.int64 else from_planes(x) for x in table.column(name).to_pylist()]
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    ids = np.repeat(joined("ids", np.int64), joined("counts", "<u4"))
    sizes = [len(x) // 4 for x in table.column("low").to_pylist()]
    nul = np.repeat(np.array(table.column("nul").to_pylist(), bool), sizes)
    paths = joined("low", "<u4").astype(np.uint64) | joined("high", "<u2").astype(np.uint64) << np.uint64(32)
    return nul, ids, paths, joined("refs", np.int64), [x for row in table.column("spelt").to_pylist() for x in row]


def deep_nodes(nul: np.ndarray, ids: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For leaves in the order (path, nul, id): the place of the first leaf below the same node at the window's
    depth, and whether the leaf repeats it: the first has an id, and it is less."""
    first, end = pack_runs(paths)
    head = np.repeat(first, end - first)
    return head, ~nul[head] & (nul | (ids > ids[head]))


def _pieces(paths: np.ndarray, starts: np.ndarray, refs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows that repeat the same document, cut where a path's last bits are zero, so that
    copies are cut in the same places: first word, end word, repeated document of each."""
    if not len(starts):
        return starts, starts, refs
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (refs[1:] != refs[:-1]) | ((paths[1:] & np.uint64(15)) == 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + width, refs[first]


def remove_repeats(
    docs: DataFrame,
    width: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int | None = None,
    bucket_words: int = 400_000,
    chunk: int = 4_000_000,
    with_text: bool = False,
    bits: int = 48,
    salt: int = 0,
    most_mixed: int = 1_000_000,
) -> DataFrame:
    """Remove every word covered by a window of width words that also starts in a document of smaller id.

    A row per input row: the id, n_words, n_removed, kept_sha256 and, with_text, kept (the
    words that stay, joined by a space). Windows are judged on the input. Null or empty
    texts have no words; texts shorter than width lose nothing. A null id counts as larger
    than every other, so such rows lose what any other document has and take nothing
    away. Rows of the same id take nothing from each other. Rows that share both id and
    text meet in one task. Other columns are ignored.

    Suffixes are split by variable-length prefixes into groups of at most most suffixes
    (by default so many that each shuffle partition gets about four groups). A suffix
    travels as the hash of its path down to the window's depth, in bits bits; a group sorts
    the paths of its suffixes, and each internal node at that depth gives its leaves and
    the least id below it. Before suffixes are dealt out, each task keeps the least id of a
    path in about chunk bytes of text, and compares the others with it word by word; so a
    passage that a third of the documents share reaches its group once a chunk.

    Paths are no proof. Where a document's windows lie below a node that a group found,
    their words are cut into pieces, runs of neighbouring windows, and each distinct piece
    is compared with the words of the document that it is said to repeat. A path that
    stands for different words (mixed) is found by this, and all its windows are judged
    again by their words. Beyond most_mixed such paths the work starts again with another
    hash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    id_ = F.col(f"`{id_col}`").cast("long")
    texts = docs.select(F.coalesce(id_, F.xxhash64(F.col(f"`{text_col}`").cast("string"))).alias("num"), id_.isNull().alias("nul"), F.col(f"`{text_col}`").cast("string").alias("body"))
    bounds, total = prefix_groups(texts.select("body"), width, most, chunk)
    buckets = max(shuffle_width(docs.sparkSession), total // bucket_words + 1)
    mixed, spelt = np.zeros(0, np.uint64), None
    while True:
        done = stored(_judge(texts, bounds, buckets, width, chunk, with_text, bits, salt, mixed, spelt), "judged")
        found = done.filter("mixed is not null").select("mixed").distinct()
        n = found.count()
        if not n:
            break
        if n > most_mixed:
            salt += 1
            continue
        mixed = np.sort(np.array([r["mixed"] for r in found.collect()], np.int64).view(np.uint64))  # at most most_mixed
        spelt = stored(_spell_out(texts, mixed, buckets, width, chunk, bits, salt), "spelt")
    names = ["n_words", "n_removed", F.lower(F.hex("digest")).alias("kept_sha256")] + ["kept"] * with_text
    return done.select(F.when(~F.col("nul"), F.col("num")).cast(kind).alias(id_col), *names)


def _paths(words: Words, hashes: np.ndarray, starts: np.ndarray, width: int, bits: int) -> np.ndarray:
    return window_hashes(hashes, starts, width) & np.uint64((1 << bits) - 1)


def _judge(texts: DataFrame, bounds: np.ndarray, buckets: int, width: int, chunk: int, with_text: bool, bits: int, salt: int, mixed: np.ndarray, spelt: DataFrame | None) -> DataFrame:
    """Result rows (num, nul, n_words, n_removed, digest, kept), and rows with mixed alone for each path that stands for different words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (num, nul), raw in chunks(batches, chunk):
            words = Words(raw)
            starts, text = words.windows(width)
            hashes = words.hashes(salt)
            paths = _paths(words, hashes, starts, width, bits)
            if len(mixed):
                some = ~np.isin(paths, mixed)
                starts, text, paths = starts[some], text[some], paths[some]
            group = np.searchsorted(bounds, path_codes(hashes, starts, min(DEPTH, width)), "right") - 1
            ids, nul = num[text], nul[text]
            order = np.lexsort((starts, ids, nul, paths))
            ids, nul, paths, group, starts = ids[order], nul[order], paths[order], group[order], starts[order]
            head, again = deep_nodes(nul, ids, paths)
            other = np.flatnonzero(head != np.arange(len(head)))
            differ = other[~same_words(words, starts[other], words, starts[head[other]], width)]
            once = np.ones(len(ids), bool)
            once[1:] = (paths[1:] != paths[:-1]) | (ids[1:] != ids[:-1]) | (nul[1:] != nul[:-1])
            leaf, sure = once & ~again, once & again
            yield from _pack(LEAF, group[leaf], nul[leaf], ids[leaf], paths[leaf]).to_batches(max_chunksize=64)
            yield from _pack(SURE, -1 - buckets_of(ids[sure], buckets), nul[sure], ids[sure], paths[sure]).to_batches(max_chunksize=64)
            if len(differ):
                yield from _pack(MIXED, -1 - buckets_of(ids[differ], buckets), nul[differ], ids[differ], paths[differ]).to_batches()

    def subtree(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        if key < 0:
            return table.set_column(0, "key", pa.array(np.full(len(table), -1 - key)))
        nul, ids, paths, _, _ = _unpack(table, LEAF)
        order = np.lexsort((ids, nul, paths))
        nul, ids, paths = nul[order], ids[order], paths[order]
        head, again = deep_nodes(nul, ids, paths)
        return _pack(TIED, buckets_of(ids[again], buckets), nul[again], ids[again], paths[again], ids[head[again]])

    packed = texts.select("num", "nul", "body").mapInArrow(deal, _PACKED_SQL).groupBy("key").applyInArrow(subtree, _PACKED_SQL)
    if spelt is not None:
        packed = packed.unionByName(spelt)
    placed = texts.withColumn("key", bucket_column(F.col("num"), buckets))
    rows_sql = "key bigint, row int, num bigint, nul boolean, n_words bigint, n_removed bigint, digest binary, kept string, mixed bigint, piece binary"
    rows_schema = pa.schema([("key", pa.int64()), ("row", pa.int32()), ("num", pa.int64()), ("nul", pa.bool_()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("digest", pa.binary()), ("kept", pa.string()), ("mixed", pa.int64()), ("piece", pa.binary())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """Result rows of a bucket; pieces for the buckets of the documents that they repeat; paths known as mixed."""
        num, nul = left.column("num").to_numpy(), left.column("nul").to_numpy(zero_copy_only=False)
        words = Words([x or b"" for x in left.column("body").cast(pa.large_binary()).to_pylist()])
        first = np.cumsum(words.counts) - words.counts
        kept = np.ones(len(words.start), bool)
        rnul, rids, rpaths, _, _ = _unpack(right, SURE, TIED, SPELT)
        out: list[tuple] = []
        if len(rids):
            starts, text = words.windows(width)
            some = np.isin(num, rids)[text]
            starts, text = starts[some], text[some]
            paths = _paths(words, _hashes_of(words, np.flatnonzero(np.isin(num, rids)), first, salt), starts, width, bits)
            gone = np.zeros(len(starts), bool)
            nul_s, ids_s, paths_s, _, _ = _unpack(right, SURE)
            gone |= _found(nul_s, ids_s, paths_s, nul[text], num[text], paths) >= 0
            nul_t, ids_t, paths_t, refs, _ = _unpack(right, TIED)
            at = _found(nul_t, ids_t, paths_t, nul[text], num[text], paths)
            gone |= at >= 0
            tied = np.flatnonzero(at >= 0)
            begin, end, whose = _pieces(paths[tied], starts[tied], refs[at[tied]], width)
            for a, b, ref, key in zip(*(x.tolist() for x in (begin, end, whose, buckets_of(whose, buckets)))):
                out.append((key, None, ref, None, None, None, None, None, None, words.span(a, b)))
            nul_x, ids_x, _, _, texts_x = _unpack(right, SPELT)
            if texts_x:
                known = set(zip(nul_x.tolist(), ids_x.tolist(), texts_x))
                for i in np.flatnonzero(np.isin(paths, mixed)).tolist():
                    gone[i] |= (bool(nul[text[i]]), int(num[text[i]]), words.span(starts[i], starts[i] + width)) in known
            cover = np.zeros(len(kept) + 1, np.int64)
            np.add.at(cover, starts[gone], 1)
            np.add.at(cover, starts[gone] + width, -1)
            kept = np.cumsum(cover)[:-1] <= 0
        out = list({x: None for x in out})
        bare = words.raw[: len(words.raw) - 8][np.repeat(kept, words.end - words.start + 1)].tobytes()
        sizes = np.concatenate(([0], np.cumsum(np.where(kept, words.end - words.start + 1, 0))))
        stays = np.concatenate(([0], np.cumsum(kept)))
        for i, (a, n) in enumerate(zip(first.tolist(), words.counts.tolist())):
            text_ = bare[sizes[a] : max(sizes[a], sizes[a + n] - 1)]
            out.append((left.column("key")[0].as_py(), i, int(num[i]), bool(nul[i]), n, n - int(stays[a + n] - stays[a]), hashlib.sha256(text_).digest(), text_.decode() if with_text else None, None, None))
        for path in np.unique(_unpack(right, MIXED)[2]).view(np.int64).tolist():
            out.append((0, None, None, None, None, None, None, None, path, None))
        return _table(out, rows_schema)

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        """The result rows as they are; of the pieces only paths whose words the repeated document doesn't have."""
        claim = right.column("piece").is_valid()
        claims, others = right.filter(claim), right.filter(pc.invert(claim))
        if not len(claims):
            return others
        num = np.where(left.column("nul").to_numpy(zero_copy_only=False), np.nan, 0) if len(left) else np.zeros(0)
        some = np.flatnonzero((num == 0) & np.isin(left.column("num").to_numpy(), claims.column("num").to_numpy()))
        left = left.take(pa.array(some))
        theirs = Words([x or b"" for x in left.column("body").cast(pa.large_binary()).to_pylist()])
        starts, text = theirs.windows(width)
        ids, paths = left.column("num").to_numpy()[text], _paths(theirs, theirs.hashes(salt), starts, width, bits)
        order = np.lexsort((starts, paths, ids))
        starts, ids, paths = starts[order], ids[order], paths[order]
        ours = Words(claims.column("piece").to_pylist())
        own, piece = ours.windows(width)
        own_paths = _paths(ours, ours.hashes(salt), own, width, bits)
        at = _found(np.zeros(len(ids), bool), ids, paths, np.zeros(len(own), bool), claims.column("num").to_numpy()[piece], own_paths)
        good = at >= 0
        good[good] = same_words(ours, own[good], theirs, starts[at[good]], width)
        wrong = np.unique(own_paths[~good]).view(np.int64).tolist()
        return pa.concat_tables([others, _table([(0, None, None, None, None, None, None, None, x, None) for x in wrong], rows_schema)])

    rows = placed.groupBy("key").cogroup(packed.groupBy("key")).applyInArrow(finish, rows_sql).distinct()
    return placed.groupBy("key").cogroup(rows.groupBy("key")).applyInArrow(verify, rows_sql).drop("key", "row", "piece")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _hashes_of(words: Words, texts: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the words of some texts; 0 for other words."""
    out = np.zeros(len(words.start), np.uint64)
    some = np.concatenate([np.arange(first[i], first[i] + words.counts[i]) for i in texts.tolist()]) if len(texts) else np.zeros(0, np.int64)
    out[some] = words.hashes(salt, some)
    return out


def _found(nul: np.ndarray, ids: np.ndarray, paths: np.ndarray, of_nul: np.ndarray, of_ids: np.ndarray, of_paths: np.ndarray) -> np.ndarray:
    """For each (of_nul, of_ids, of_paths) a place in the other three arrays where it stands, or -1."""
    if not len(ids):
        return np.full(len(of_ids), -1)
    n = len(ids)
    every = [np.concatenate(x) for x in ((nul, of_nul), (ids, of_ids), (paths, of_paths))]
    order = np.lexsort((np.arange(n + len(of_ids)), every[2], every[1], every[0]))
    first, end = pack_runs(*(x[order] for x in every))
    head = np.empty(len(order), np.int64)
    head[order] = np.repeat(order[first], end - first)
    return np.where(head[n:] < n, head[n:], -1)


def _spell_out(texts: DataFrame, mixed: np.ndarray, buckets: int, width: int, chunk: int, bits: int, salt: int) -> DataFrame:
    """Packed rows of the windows on mixed paths that repeat a document of smaller id, told apart by their words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (num, nul), raw in chunks(batches, chunk):
            words = Words(raw)
            starts, text = words.windows(width)
            some = np.flatnonzero(np.isin(_paths(words, words.hashes(salt), starts, width, bits), mixed))
            spans = [words.span(a, a + width) for a in starts[some].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(num[text[some]]), pa.array(nul[text[some]]), pa.array(spans, pa.binary())], ["num", "nul", "words"])

    each = stored(texts.select("num", "nul", "body").mapInArrow(emit, "num bigint, nul boolean, words binary").distinct(), "windows")
    least = each.filter("not nul").groupBy("words").agg(F.min("num").alias("least"))
    again = each.join(least, "words").filter("nul or num > least").withColumn("key", bucket_column(F.col("num"), buckets))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, num, nul = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield from _pack(SPELT, key, nul, num, np.zeros(len(num), np.uint64), spelt=batch.column(3).to_pylist()).to_batches()

    return again.select("key", "num", "nul", "words").mapInArrow(pack, _PACKED_SQL)
