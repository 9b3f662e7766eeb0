"""Near-duplicate vectors by a robust-pruned flat graph over overlapping shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, pack_runs, shuffle_width, stored
from .graph import components


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=-1, keepdims=True)


def centres(sample: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Spherical k-means of the sample, started from rows spread over it."""
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(turns):
        own = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), found)
    return found


def robust_prune(rows: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-neighbours of each of nodes (-1: none): of its candidates, nearest first, one is dropped if a chosen one
    is alpha times nearer to it than the node is. cand is padded by -1; repeats and the node itself are ignored.

    Nodes are pruned in blocks, so the scratch space is bounded by the block.
    """
    out = np.full((len(nodes), degree), -1, np.int64)
    step = max(1, 8_000_000 // (cand.shape[1] * max(cand.shape[1], rows.shape[1]) + 1))
    for a in range(0, len(nodes), step):
        own, some = nodes[a : a + step], np.sort(cand[a : a + step], axis=1)
        alive = (some >= 0) & (some != own[:, None])
        alive[:, 1:] &= some[:, 1:] != some[:, :-1]
        vectors = rows[some]
        near = np.where(alive, (vectors @ rows[own][:, :, None])[:, :, 0], -3.0)
        order = np.argsort(-near, axis=1)
        some, alive, near = (np.take_along_axis(x, order, axis=1) for x in (some, alive, near))
        vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
        between, distance = 1 - np.matmul(vectors, vectors.transpose(0, 2, 1)), 1 - near
        count = np.zeros(len(own), np.int64)
        for j in range(some.shape[1]):
            take = np.flatnonzero(alive[:, j] & (count < degree))
            if not len(take) and not (alive[:, j:].any(axis=1) & (count < degree)).any():
                break
            out[a + take, count[take]] = some[take, j]
            count[take] += 1
            alive[take] &= alpha * between[take, j] > distance[take]
    return out


def greedy_search(rows: np.ndarray, lists: np.ndarray, start: int, queries: np.ndarray, beam: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the nodes that a greedy search from start meets, as a mask over all rows; block by block,
    with the similarities of the nodes met (-2 for others).

    Each turn expands the nearest open node of every query among the beam nearest ones it knows.
    """
    for a in range(0, len(queries), block):
        own = queries[a : a + block]
        n = len(own)
        sims = np.full((n, len(rows)), -2.0, np.float32)
        sims[:, start] = own @ rows[start]
        open_ = np.zeros((n, len(rows)), bool)
        open_[:, start] = True
        best = np.full((n, beam), -1, np.int64)  # the beam nearest nodes known
        best[:, 0] = start
        active = np.arange(n)
        while len(active):
            front = best[active]
            worth = np.where((front >= 0) & open_[active[:, None], front], sims[active[:, None], front], -3.0)
            pick = worth.argmax(axis=1)
            going = worth[np.arange(len(active)), pick] > -3
            active, front, pick = active[going], front[going], pick[going]
            if not len(active):
                break
            node = front[np.arange(len(active)), pick]
            open_[active, node] = False
            new = lists[node]
            fresh = (new >= 0) & (sims[active[:, None], new] == -2)
            q, k = np.nonzero(fresh)
            found = np.full(new.shape, -3.0, np.float32)
            for i in range(0, len(q), 50_000):
                found[q[i : i + 50_000], k[i : i + 50_000]] = np.einsum("pd,pd->p", rows[new[q[i : i + 50_000], k[i : i + 50_000]]], own[active[q[i : i + 50_000]]])
            sims[active[q], new[q, k]] = found[q, k]
            open_[active[q], new[q, k]] = True
            ids = np.concatenate((front, np.where(fresh, new, -1)), axis=1)
            value = np.concatenate((np.where(front >= 0, sims[active[:, None], front], -3.0), found), axis=1)
            best[active] = np.take_along_axis(ids, np.argpartition(-value, beam - 1, axis=1)[:, :beam], axis=1)
        yield sims, open_


def medoid(rows: np.ndarray) -> int:
    return int((rows @ rows.mean(axis=0)).argmax())


def build_graph(rows: np.ndarray, degree: int, alpha: float, beam: int, seed: int = 7) -> np.ndarray:
    """Out-neighbours of every row (-1: none), by inserting the rows in a random order, in batches that double up
    to 128: each searches the graph so far from the medoid, prunes what it met, and its neighbours prune in turn.

    Only rows that a search meets are compared; no row meets all others.
    """
    n, rows = len(rows), rows.astype(np.float32)
    lists = np.full((n, degree), -1, np.int64)
    if n < 2:
        return lists
    start = medoid(rows)
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    done = 0
    while done < len(order):
        batch = order[done : done + max(1, min(128, done))]
        done += len(batch)
        cand = np.full((len(batch), 4 * degree), -1, np.int64)
        at = 0
        for sims, _ in greedy_search(rows, lists, start, rows[batch], beam):
            keep = min(cand.shape[1], sims.shape[1])
            near = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
            cand[at : at + len(sims), :keep] = np.where(np.take_along_axis(sims, near, axis=1) > -2, near, -1)
            at += len(sims)
        lists[batch] = robust_prune(rows, batch, cand, degree, alpha)
        source, target = np.repeat(batch, degree), lists[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        turn = np.argsort(target, kind="stable")
        source, target = source[turn], target[turn]
        first, end = pack_runs(target)
        incoming = np.full((len(first), int((end - first).max(initial=0))), -1, np.int64)
        incoming[np.repeat(np.arange(len(first)), end - first), np.arange(len(target)) - np.repeat(first, end - first)] = source
        touched = target[first]
        lists[touched] = robust_prune(rows, touched, np.concatenate((lists[touched], incoming), axis=1), degree, alpha)
    return lists


def in_range(rows: np.ndarray, lists: np.ndarray, least: float, slack: float, beam: int) -> list[np.ndarray]:
    """For every row the other rows found with a similarity of least or more: greedy search from the medoid, then
    expansion over all nodes in range; nodes down to least - slack are expanded too."""
    out, near = [], rows.astype(np.float32)
    for sims, open_ in greedy_search(near, lists, medoid(rows), near, beam):
        at = len(out)
        while True:
            q, node = np.nonzero(open_ & (sims >= least - slack))
            if not len(q):
                break
            open_[q, node] = False
            new = lists[node]
            q = np.repeat(q, new.shape[1])[new.ravel() >= 0]
            new = new.ravel()[new.ravel() >= 0]
            fresh = np.unique(q[sims[q, new] == -2] * len(rows) + new[sims[q, new] == -2])
            q, new = fresh // len(rows), fresh % len(rows)
            for a in range(0, len(q), 100_000):
                sims[q[a : a + 100_000], new[a : a + 100_000]] = np.einsum("pd,pd->p", near[new[a : a + 100_000]], near[at + q[a : a + 100_000]])
            open_[q, new] = True
        for i, row in enumerate(sims):
            found = np.flatnonzero(row >= least - 1e-5)
            found = found[found != at + i]
            out.append(found[(rows[found] * rows[at + i]).sum(axis=1) >= least])  # in double precision
    return out


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long float lists as rows in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 1))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.95,
    shard_size: int = 1500,
    overlap: int = 2,
    degree: int = 32,
    alpha: float = 1.2,
    beam: int = 32,
    slack: float = 0.03,
    sample: int = 20_000,
    audit_queries: int = 200,
    audit_links: int = 100,
    most_audited: int = 20_000,
    recall: float = 0.98,
    seed: int = 11,
) -> DataFrame:
    """Link vectors whose cosine is least or more; a row per input row: id, n_links, component_id, kept, recall.

    Vectors that are null, empty, zero, or hold null or non-finite values link with
    nothing; vectors of different lengths don't link. Rows with a null id are measured,
    have component_id null unless linked, and are never kept. Equal vectors are one node
    with a weight. Other columns are ignored.

    Vectors of a length are cut into clusters of about shard_size by k-means, a tree of it
    where they are many: centres come from at most sample vectors of a cluster, and a cluster that is
    still too large is cut again. At every cut a vector goes to its overlap nearest
    centres, so shards overlap. Each shard gives a robust-pruned graph (build_graph), and the lists that a vector
    has in its shards are united. Then every vector is searched for in each of its shards,
    from the shard's medoid over the united lists, and what is in range is verified in
    double precision.

    The audit compares vectors drawn by a hash with brute force against all rows: first
    audit_queries of them, then as many again and again, until audit_links links were
    met, all vectors or most_audited were audited. recall is the mean share of links found,
    over the audited vectors that have links (null if none has); below the wanted recall it
    is all done again with one more shard for each vector.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    all_rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.col(f"`{vector_col}`").cast("array<double>").alias("v_"))
    norm = F.aggregate("v_", F.lit(0.0), lambda a, x: a + x * x)
    good = all_rows.filter(F.col("v_").isNotNull() & (F.size("v_") > 0) & ~F.exists("v_", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter((norm > 0) & (norm < float("inf")))
    nodes = good.groupBy("v_").agg(F.min("id_").alias("id"), F.count("*").alias("weight"))
    nodes = stored(nodes.withColumn("node", F.coalesce("id", F.xxhash64("v_"))), "nodes")
    lengths = {r["n"]: r["count"] for r in nodes.groupBy(F.size("v_").alias("n")).count().filter("count > 1").collect()}  # a row for each length
    truth = Audit(nodes, least, seed, audit_queries, audit_links, most_audited)
    while True:
        found, most_shards = None, 1
        for length, n in sorted(lengths.items()):
            own = nodes.filter(F.size("v_") == length).select("node", "weight", "v_")
            member, shards = _shards(own, n, shard_size, sample, overlap, seed)
            links = _links(spark, member, least, degree, alpha, beam, slack)
            found, most_shards = links if found is None else found.unionByName(links), max(most_shards, shards)
        if found is None:
            found = spark.createDataFrame([], "node bigint, n_links bigint, ends array<bigint>")
        measured = truth.recall(found)
        if measured is None or measured >= recall or overlap >= most_shards:
            break
        overlap += 1
    labels = components(found.select("node", F.explode("ends").alias("end")))
    counted = nodes.join(found.select("node", "n_links"), "node", "left").join(labels.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left")
    # the component is the least id in it; a node whose rows all have null ids has no id
    least_id = counted.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("id").alias("least_id"))
    counted = stored(counted.join(least_id, F.coalesce("component", "node") == F.col("c")).select("v_", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least_id"), "counted")
    joined = all_rows.join(counted, "v_", "left")
    component = F.coalesce("least_id", "id_")
    return joined.select(
        F.col("id_").cast(kind).alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast(kind).alias("component_id"),
        F.coalesce(F.col("id_") == component, F.lit(False)).alias("kept"),
        F.lit(measured).cast("double").alias("recall"),
    )


_MEMBER = "shard bigint, node bigint, weight bigint, v_ array<double>"


def _shards(nodes: DataFrame, n: int, shard_size: int, sample: int, overlap: int, seed: int, widest: int = 256) -> tuple[DataFrame, int]:
    """Rows (shard, node, weight, v_), overlap or more of each node, and in how many centres the first cut was made.

    A turn cuts every cluster of more than twice shard_size by its own centres, at most
    widest of them from at most sample of its vectors, which are as many numbers whatever the input. A
    cluster that a turn doesn't make smaller (vectors all alike) is left as it is.
    """
    spark = nodes.sparkSession
    todo, ready, first = stored(nodes.withColumn("shard", F.lit(0).cast("long")).withColumn("parent", F.lit(2**62)), "members"), [], 1
    while True:
        sizes = todo.groupBy("shard").agg(F.count("*").alias("many"), F.min("parent").alias("parent"))
        sizes = stored(sizes.withColumn("cut", (F.col("many") > 2 * shard_size) & (F.col("many") < 0.9 * F.col("parent"))), "sizes")
        large = sizes.filter("cut").select("shard", "many")
        ready.append(todo.join(sizes.filter("not cut").select("shard"), "shard").select("shard", "node", "weight", "v_"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, ready), first
        rows = stored(todo.drop("parent").join(large, "shard"), "large")

        def cut(table: pa.Table) -> pa.Table:
            found = unit(_matrix(table.column("v_")))
            k = min(widest, len(found), -(-table.column("many")[0].as_py() // shard_size))
            middle = centres(found[np.argsort(table.column("node").to_numpy())], k)
            return pa.table({"shard": pa.array([table.column("shard")[0].as_py()]), "centres": pa.array([middle.astype("<f8").tobytes()], pa.binary())})

        drawn = rows.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.col("many")) < F.lit(sample))  # about sample of each cluster
        middle = stored(drawn.select("shard", "node", "v_", "many").groupBy("shard").applyInArrow(cut, "shard bigint, centres binary"), "centres")
        first = max(first, -(-n // shard_size)) if first == 1 else first

        def assign(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left):
                return _member_rows(left, np.zeros(0, int), np.zeros(0, np.int64))
            vectors = unit(_matrix(left.column("v_")))
            if not len(right):  # no vector was drawn
                return _member_rows(left, np.arange(len(left)), left.column("shard").to_numpy())
            own = np.frombuffer(right.column("centres")[0].as_py(), "<f8").reshape(-1, vectors.shape[1])
            near = np.argsort(-(vectors @ own.T), axis=1)[:, : min(overlap, len(own))]
            shard = left.column("shard")[0].as_py()
            return _member_rows(left, np.repeat(np.arange(len(left)), near.shape[1]), mix(np.uint64(shard % 2**64) + near.ravel().astype(np.uint64) + np.uint64(1)).view(np.int64))

        salted = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("many") / 20_000)))
        salts = middle.join(large, "shard").select("shard", "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("many") / 20_000) - 1)).alias("salt"))
        left = salted.select("shard", "salt", "node", "weight", "v_", "many")
        dealt = left.groupBy("shard", "salt").cogroup(salts.select("shard", "salt", "centres").groupBy("shard", "salt")).applyInArrow(assign, _MEMBER + ", parent bigint")
        todo = stored(dealt.dropDuplicates(["shard", "node"]), "members")


def _member_rows(table: pa.Table, at: np.ndarray, shards: np.ndarray) -> pa.Table:
    rows = table.take(pa.array(at, pa.int64()))
    return pa.table([pa.array(shards, pa.int64()), rows.column("node"), rows.column("weight"), rows.column("v_"), rows.column("many")], names=["shard", "node", "weight", "v_", "parent"])


def _links(spark, member: DataFrame, least: float, degree: int, alpha: float, beam: int, slack: float) -> DataFrame:
    """(node, n_links: weight of the other nodes linked with it, ends: nodes that connect its component)."""
    member = stored(member, "members")

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        lists = build_graph(unit(_matrix(table.column("v_"))), degree, alpha, beam)
        return pa.table({"node": pa.array(ids), "near": pa.array([ids[x[x >= 0]].tolist() for x in lists], pa.list_(pa.int64()))})

    lists = member.groupBy("shard").applyInArrow(build, "node bigint, near array<bigint>")
    lists = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one list from each of its shards

    def search(table: pa.Table) -> pa.Table:
        ids, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        rows = unit(_matrix(table.column("v_")))
        order = np.argsort(ids)
        near = [np.array(x or [], np.int64) for x in table.column("near").to_pylist()]
        flat = np.concatenate(near)
        at = order[np.minimum(np.searchsorted(ids[order], flat), len(ids) - 1)]
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in near])
        here = ids[at] == flat
        found = in_range(rows, _padded(owner[here], at[here], len(ids)), least, slack, beam)
        linked = np.zeros((len(ids), len(ids)), bool)
        for i, others in enumerate(found):
            linked[i, others] = True
        linked |= linked.T.copy()  # a link is found from both ends or from one
        label = np.arange(len(ids))
        for i in range(len(ids)):  # spanning links: each node with the least label around it
            around = np.flatnonzero(linked[i])
            if len(around):
                merged = np.unique(label[np.append(around, i)])
                if len(merged) > 1:
                    label[np.isin(label, merged)] = merged[0]
        some = np.flatnonzero(linked.any(axis=1))
        return pa.table(
            {
                "node": pa.array(ids[some]),
                "end": pa.array(ids[label[some]]),
                "others": pa.array([ids[linked[i]].astype("<i8").tobytes() for i in some], pa.binary()),
                "weights": pa.array([weight[linked[i]].astype("<i8").tobytes() for i in some], pa.binary()),
            }
        )

    joined = member.join(lists, "node").select("shard", "node", "weight", "v_", "near")
    found = joined.groupBy("shard").applyInArrow(search, "node bigint, end bigint, others binary, weights binary")
    groups = shuffle_width(spark)

    def merge(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        others, weights, ends = (table.column(c).to_pylist() for c in ("others", "weights", "end"))
        out: list[list] = [[], [], []]
        order = np.argsort(ids, kind="stable")
        cuts = np.flatnonzero(ids[order][1:] != ids[order][:-1]) + 1
        for rows in np.split(order, cuts):
            _, first = np.unique(np.concatenate([np.frombuffer(others[i], "<i8") for i in rows]), return_index=True)
            out[0].append(int(ids[rows[0]]))
            out[1].append(int(np.concatenate([np.frombuffer(weights[i], "<i8") for i in rows])[first].sum()))
            out[2].append(sorted({ends[i] for i in rows}))
        return pa.table({"node": pa.array(out[0], pa.int64()), "n_links": pa.array(out[1], pa.int64()), "ends": pa.array(out[2], pa.list_(pa.int64()))})

    keyed = found.withColumn("key", F.pmod(F.xxhash64("node"), F.lit(16 * groups)))
    return stored(keyed.groupBy("key").applyInArrow(merge, "node bigint, n_links bigint, ends array<bigint>"), "links")


def _padded(owner: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Lists as rows of targets, padded by -1; owner is sorted."""
    sizes = np.bincount(owner, minlength=n)
    out = np.full((n, max(1, int(sizes.max(initial=0)))), -1, np.int64)
    out[owner, np.arange(len(other)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = other
    return out


class Audit:
    """Vectors drawn by a hash, and how many links each really has, by brute force."""

    def __init__(self, nodes: DataFrame, least: float, seed: int, step: int, links: int, most: int):
        self.truth: dict[int, int] = {}
        order = [F.xxhash64("node", F.lit(seed)), F.col("node")]
        drawn = nodes.select("node", "v_", order[0].alias("h")).orderBy("h", "node").limit(most)  # at most most rows
        drawn = stored(drawn, "audit")
        size, last = step, None
        while True:
            part = drawn if last is None else drawn.filter((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("node") > last[1])))
            part = part.orderBy("h", "node").limit(size).collect()  # at most most rows in all
            if not part:
                break
            last, size = (part[-1]["h"], part[-1]["node"]), 2 * size
            self.truth |= _true_links(nodes, part, least)
            if sum(self.truth.values()) >= links:
                break

    def recall(self, found: DataFrame) -> float | None:
        """The mean share of the links found, over audited vectors that have any."""
        linked = {q: t for q, t in self.truth.items() if t}
        if not linked:
            return None
        ours = {r["node"]: r["n_links"] for r in found.filter(F.col("node").isin(list(linked))).select("node", "n_links").collect()}
        return float(np.mean([min(ours.get(q, 0), t) / t for q, t in linked.items()]))


def _true_links(nodes: DataFrame, probes: list, least: float) -> dict[int, int]:
    """The weight of the other nodes in range of each of a bounded number of probes."""
    queries = np.array([r["node"] for r in probes], np.int64)
    of_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = np.array([len(r["v_"]) for r in probes])
    for n in set(sizes.tolist()):
        at = np.flatnonzero(sizes == n)
        of_length[n] = at, unit(np.array([probes[i]["v_"] for i in at], float))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(queries), np.int64)
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            for n in set(lengths.tolist()) & set(of_length):
                part = batch.filter(pa.array(lengths == n))
                at, rows = of_length[n]
                all_ = unit(_matrix(part.column(2)))
                ids, weight = part.column(0).to_numpy(), part.column(1).to_numpy()
                for a in range(0, len(at), 1000):
                    own = at[a : a + 1000]
                    sums[own] += ((rows[a : a + 1000] @ all_.T >= least) & (queries[own][:, None] != ids[None])) @ weight
        yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(sums)], ["node", "n"])

    found = nodes.select("node", "weight", "v_", F.size("v_").alias("n")).mapInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
    return {r["node"]: r["n"] for r in found.collect()}
