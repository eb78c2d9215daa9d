"""Approximate nearest neighbours by inner product: hierarchical k-means tree.

The tree is fitted on a bounded sample and indexes every row.  A query walks it
best bin first: a priority queue holds subtrees by the distance of their centre,
the nearest is popped and descended, its siblings are queued.  Leaf visits are
widened until the recall of a set of check queries, searched exactly over all
rows, reaches the target; with every leaf visited the search is exact.  A query
whose leaves hold too few distinct ids visits more of them.  The recall measured on
the check queries is returned with every row.

Inner products of vectors of unequal length are reduced to distances by one added
coordinate that makes all lengths equal.  Leaves are cut into blocks by a hash of
the row id, and the queries of a leaf likewise, so that a task holds one bounded
block of each, whatever the size of a leaf; a leaf is sent once for each block of
the queries that visit it, and not at all if none does.

Defined results: vectors that are null, zero, or that hold null or non-finite
components take no part; vectors are compared with those of their own length, and
each length is searched by itself; a repeated id counts once for each length, with its
best score, and as a query its smallest vector stands; ties go to the smaller id; a query with fewer candidates returns them all;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import scratch

K = 20
SAMPLE = 20_000
BRANCH = 8
#: Leaves grow with the rows, from this many on, as far as the sample can tell them
#: apart.
MAX_LEAVES = 256
ROWS_A_LEAF = 4096
MAX_SAMPLE = 100_000
CHECKS = 64
TARGET = 0.95
BLOCK = 16_384


@dataclass
class Tree:
    """Nodes by number: centre, children (none for a leaf), leaf number."""

    dim: int
    longest: float
    centres: np.ndarray
    children: list[np.ndarray] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(1)))
        return np.column_stack((vectors, rest))

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at every level."""
        lifted, out = self.lifted(vectors), np.zeros(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(self.children[node]):
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = self.children[node]
                near = _distances(lifted[rows], self.centres[kids]).argmin(1)
                todo += [(int(kids[k]), rows[near == k]) for k in range(len(kids))]
        return out

    def visits(self, query: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first; more until ``sizes`` adds up to ``least`` rows."""
        point = np.append(query, 0.0)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, node = heapq.heappop(queue)
            while len(self.children[node]):
                kids = self.children[node]
                far = _distances(point[None], self.centres[kids])[0]
                best = int(far.argmin())
                for k, kid in enumerate(kids):
                    if k != best:
                        heapq.heappush(queue, (float(far[k]), int(kid)))
                node = int(kids[best])
            out.append(self.leaf[node])
            held += (sizes or {}).get(self.leaf[node], 0)
        return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None]


def fit(sample: np.ndarray, longest: float, branch: int = BRANCH, max_leaves: int = MAX_LEAVES, rounds: int = 8) -> Tree:
    """Splits the fullest leaf into ``branch`` until ``max_leaves`` are reached."""
    rng = np.random.default_rng(7)
    tree = Tree(sample.shape[1], longest, np.zeros((1, sample.shape[1] + 1)), [np.zeros(0, np.int64)], [0])
    lifted = tree.lifted(sample)
    centres, full, leaves = [lifted.mean(0) if len(lifted) else np.zeros(tree.dim + 1)], [(-len(lifted), 0, np.arange(len(lifted)))], 1
    while full and leaves + branch - 1 <= max_leaves:
        size, node, rows = heapq.heappop(full)
        if -size < 4 * branch:
            break
        points = lifted[rows]
        middle = points[rng.choice(len(points), branch, replace=False)]
        for _ in range(rounds):
            near = _distances(points, middle).argmin(1)
            middle = np.stack([points[near == k].mean(0) if (near == k).any() else middle[k] for k in range(branch)])
        near = _distances(points, middle).argmin(1)
        groups = [k for k in range(branch) if (near == k).any()]
        if len(groups) < 2:
            continue
        tree.children[node] = np.arange(len(centres), len(centres) + len(groups))
        for k in groups:
            heapq.heappush(full, (-int((near == k).sum()), len(centres), rows[near == k]))
            centres.append(middle[k])
            tree.children.append(np.zeros(0, np.int64))
        leaves += len(groups) - 1
    tree.centres = np.array(centres)
    tree.leaf = [-1] * len(centres)
    for node in range(len(centres)):
        if not len(tree.children[node]):
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
    return tree


def usable(vectors: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vectors, lambda x: x != 0), F.lit(False))


def _unpacked(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products whose rounding does not depend on a row's place."""
    return (rows * query).sum(1)


def top(query_id: int, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids other than the query's own, by score, then id."""
    cut = -np.inf
    want = k + 1
    while True:
        if want < len(rough):
            cut = np.partition(rough, len(rough) - want)[len(rough) - want]
            cut -= 1e-9 * max(1.0, abs(float(cut)))
        else:
            cut = -np.inf
        some = np.flatnonzero((rough >= cut) & (ids != query_id))
        scores = exact_scores(query, rows[some])
        order = np.lexsort((ids[some], -scores))
        _, first = np.unique(ids[some][order], return_index=True)
        order = order[np.sort(first)]
        if len(order) >= k or cut == -np.inf:
            return ids[some][order[:k]], scores[order[:k]]
        want *= 2


def _search(queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at in range(0, len(queries[0]), 256):
        part_ids, part = queries[0][at : at + 256], queries[1][at : at + 256]
        rough = part @ rows.T
        for q, vector, line in zip(part_ids.tolist(), part, rough):
            found, scores = top(q, vector, ids, rows, line, k)
            if len(found):
                yield q, found, scores


_PARTIAL = "query_id long, ids array<long>, scores array<double>"


def _packed(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
        ["query_id", "ids", "scores"],
    )


def merged(partial: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best over all partial lists.

    A query has one list of at most k for each block that it visits.
    """

    def best(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks().flatten().to_numpy()
        scores = table.column("scores").combine_chunks().flatten().to_numpy()
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)][:k]
        n = len(order)
        return pa.table({"query_id": pa.array([table.column("query_id")[0].as_py()] * n, pa.int64()), "rank": pa.array(np.arange(1, n + 1, dtype=np.int32)), "vec_id": pa.array(ids[order]), "score": pa.array(scores[order])})

    return partial.groupBy("query_id").applyInArrow(best, "query_id long, rank int, vec_id long, score double")


def _brute(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> dict[int, list[int]]:
    """Exact results of a few queries, blocked over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def task(batches):
        ids, found = queries_of(shared), {}
        for batch in batches:
            if batch.num_rows:
                for q, i, s in _search(ids, batch.column(0).to_numpy(), _unpacked(batch.column(1)), k):
                    old = found.get(q)
                    i, s = (np.concatenate((old[0], i)), np.concatenate((old[1], s))) if old else (i, s)
                    order = np.lexsort((i, -s))
                    _, first = np.unique(i[order], return_index=True)
                    order = order[np.sort(first)][:k]
                    found[q] = (i[order], s[order])
        if found:
            yield _packed([(q, *x) for q, x in found.items()])

    out: dict[int, list[int]] = {}
    for row in merged(rows.select("id", "vec").mapInArrow(task, _PARTIAL), k).collect():
        out.setdefault(row.query_id, []).append(row.vec_id)
    return out


def queries_of(shared) -> tuple[np.ndarray, np.ndarray]:
    return shared.value


def search(embeddings: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, target: float = TARGET, sample: int = SAMPLE, branch: int = BRANCH, max_leaves: int = MAX_LEAVES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row marked as a query.

    The tree is fitted on ``sample`` rows, or a fiftieth of them, ``MAX_SAMPLE`` at most.
    """
    all_rows = embeddings.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # Only vectors of one length can be compared; each length has a tree of its own.
    lengths = {r.dim: r.n for r in all_rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [_of_length(all_rows.filter(F.size("vec") == dim), n, k, target, sample, branch, max_leaves, block) for dim, n in sorted(lengths.items())]
    return reduce(DataFrame.unionByName, parts) if parts else embeddings.sparkSession.createDataFrame([], _FOUND)


_FOUND = "query_id long, rank int, vec_id long, score double, recall double"


def _of_length(rows: DataFrame, n_rows: int, k: int, target: float, sample: int, branch: int, max_leaves: int, block: int) -> DataFrame:
    """The search over vectors of one length."""
    spark = rows.sparkSession
    sample = max(sample, min(MAX_SAMPLE, n_rows // 50))
    drawn = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id", "vec").limit(sample).toArrow()
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    longest = rows.agg(F.max(length)).first()[0]
    points = _unpacked(drawn.column("vec"))
    tree = fit(points, longest, branch, max(max_leaves, min(len(points) // (4 * branch), n_rows // ROWS_A_LEAF)))
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                leaves = shared.value.assign(_unpacked(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int32())], [*batch.schema.names, "leaf"])

    index = scratch.cut(rows.mapInArrow(placed, "id long, vec array<double>, asks boolean, leaf int"))
    queries = index.filter("asks").groupBy("id").agg(F.min("vec").alias("vec"))
    checks = queries.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CHECKS).toArrow()
    if not checks.num_rows:
        return spark.createDataFrame([], _FOUND)
    check = (checks.column("id").to_numpy(), _unpacked(checks.column("vec")))
    truth = _brute(index, check, k)
    # One short row a leaf; leaves are at most max_leaves.
    counts = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}
    visits, recall = _calibrated(index, tree, check, truth, k, target)
    found = scratch.cut(_run(index, queries, tree, visits, counts, k, block))
    while visits < tree.leaves:
        # Repeated ids may fill the visited leaves: such queries ask more of them.
        short = scratch.cut(queries.join(found.filter(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti"))
        if short.isEmpty():
            break
        visits = min(tree.leaves, 4 * visits)
        again = scratch.cut(_run(index, short, tree, visits, counts, k, block))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.withColumn("recall", F.lit(recall))


def _calibrated(index: DataFrame, tree: Tree, check, truth: dict[int, list[int]], k: int, target: float) -> tuple[int, float]:
    """Leaf visits that reach the target recall on the check queries, and that recall.

    The leaf of each true neighbour tells how far a query must widen to find it.
    """
    wanted = sorted({v for ids in truth.values() for v in ids})
    if not wanted:
        return tree.leaves, 1.0
    home = {r.id: r.leaf for r in index.join(F.broadcast(index.sparkSession.createDataFrame([(w,) for w in wanted], "id long")), "id").select("id", "leaf").collect()}
    depth = []
    for q, vector in zip(check[0].tolist(), check[1]):
        at = {leaf: n for n, leaf in enumerate(tree.visits(vector, tree.leaves), 1)}
        depth += [at[home[v]] for v in truth.get(q, ())]
    depth.sort()
    visits = depth[min(len(depth) - 1, int(np.ceil(target * len(depth))))]
    return visits, sum(d <= visits for d in depth) / len(depth)


def _run(index: DataFrame, queries: DataFrame, tree: Tree, visits: int, counts: dict[int, int], k: int, block: int) -> DataFrame:
    """Each tile joins one block of a leaf with one share of the queries that visit it.

    A query visits ``visits`` leaves, and more until they hold k rows beside itself.
    """
    shared = index.sparkSession.sparkContext.broadcast((tree, counts))

    def asked(batches):
        known, sizes = shared.value
        for batch in batches:
            vectors = _unpacked(batch.column(1)) if batch.num_rows else []
            ids, vecs, leaves, parts = [], [], [], []
            for q, vector in zip(batch.column(0).to_pylist(), vectors):
                for leaf in known.visits(vector, visits, sizes, k + 1):
                    for part in range(-(-sizes.get(leaf, 0) // block)):
                        ids.append(q), vecs.append(vector), leaves.append(leaf), parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.list_(pa.float64())), pa.array(leaves, pa.int32()), pa.array(parts, pa.int32())], ["id", "vec", "leaf", "part"])

    def asking(batches):
        known, sizes = shared.value
        seen: Counter = Counter()
        for batch in batches:
            for vector in _unpacked(batch.column(1)) if batch.num_rows else []:
                seen.update(known.visits(vector, visits, sizes, k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["leaf", "n"])

    # Queries of each leaf; a short row a leaf.
    load = {r.leaf: -(-r.n // block) for r in queries.mapInArrow(asking, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    if not load:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shares = F.create_map(*[F.lit(x) for item in sorted(load.items()) for x in item])
    sizes = F.create_map(*[F.lit(x) for leaf, n in sorted(counts.items()) for x in (leaf, -(-n // block))])
    asks = queries.mapInArrow(asked, "id long, vec array<double>, leaf int, part int").withColumn("share", F.pmod(F.xxhash64("id"), shares[F.col("leaf")]).cast("int"))
    held = index.filter(F.map_contains_key(shares, F.col("leaf"))).select("id", "vec", "leaf", F.pmod(F.xxhash64("id"), sizes[F.col("leaf")]).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), (shares[F.col("leaf")] - 1).cast("int"))).alias("share"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            queries_here = (left.column("id").to_numpy(), _unpacked(left.column("vec")))
            found = list(_search(queries_here, right.column("id").to_numpy(), _unpacked(right.column("vec")), k))
        return pa.Table.from_batches([_packed(found)])

    partial = asks.groupBy("leaf", "part", "share").cogroup(held.groupBy("leaf", "part", "share")).applyInArrow(tile, _PARTIAL)
    return merged(partial, k)
