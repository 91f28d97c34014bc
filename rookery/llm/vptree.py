"""Approximate nearest neighbours with vantage-point trees.

Distinct vectors are points; of the ids at one point the k + 1 smallest can matter and are kept. A top tree, fitted on a bounded sample of the
points (SAMPLE rows, SAMPLE_VALUES components; see top_trees), routes every point to a cell; a cell of more than `shard` points is cut by hash
into shards. Each shard's tree is built once and stored. A query is searched in its own cell; with the radius that gives, it goes on only to
the cells that the relaxed triangle inequality does not exclude, and within a tree likewise: a side is searched only if
relax * (its distance from the query by the inequality) <= radius. relax = 1 is exact search; more prunes more.

In a tree all queries of a block walk together. A leaf is one matrix product, which proposes what may lie within the radius with room for
its rounding; only those distances are then computed as the definition says.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rookery.llm.common import cut, drop, narrow

#: Points of a shard, queries of a block, points of a leaf; cells of the top tree at most.
SHARD, QUERIES, LEAF, CELLS = 4096, 1024, 256, 1024
#: What the top tree is fitted on: points at most, and components of them in all (16 MB).
SAMPLE, SAMPLE_VALUES = 16384, 1 << 21
FAR = np.iinfo(np.int64).max


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.sqrt(((a - b) ** 2).sum(-1))


def _halves(points: np.ndarray, rows: np.ndarray, dice) -> tuple[int, np.ndarray, np.ndarray, float, float]:
    """A vantage point, the nearer and the further half of the other rows in order of distance, and the bounds between them."""
    at = int(dice.integers(len(rows)))
    rest = np.delete(rows, at)
    d = distances(points[rest], points[rows[at]])
    order = np.argsort(d, kind="stable")
    half = (len(rest) + 1) // 2
    return int(rows[at]), rest[order[:half]], rest[order[half:]], float(d[order[half - 1]]), float(d[order[min(half, len(rest) - 1)]])


class VantageTree:
    """Over distinct points; first[i] is the least id at point i. Nodes are rows (vantage, nearer, further), leaves are runs of `order`."""

    def __init__(self, points: np.ndarray, first: np.ndarray, leaf: int = LEAF):
        self.points, self.first = points, first
        nodes, bounds, order, dice = [], [], [], np.random.default_rng(len(points))

        def build(rows: np.ndarray) -> int:
            me = len(nodes)
            nodes.append([-1, len(order), len(order) + len(rows)])
            bounds.append((0.0, 0.0))
            if len(rows) <= leaf:
                order.extend(rows.tolist())
                return me
            vantage, near, far, low, high = _halves(points, rows, dice)
            bounds[me] = (low, high)
            nodes[me] = [vantage, build(near), build(far)]
            return me

        build(np.arange(len(points)))
        self.nodes, self.bounds, self.order = np.array(nodes, np.int64).reshape(-1, 3), np.array(bounds), np.array(order, np.int64)

    def nearest(self, queries: np.ndarray, most: int, radius: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, points) of the `most` nearest found within the radius of each query, nearest first, ties to the smaller first id; inf and -1 fill up."""
        self.q, self.limit, self.relax = queries, radius, relax
        shape = (len(queries), most)
        self.d, self.at, self.ids = np.full(shape, np.inf), np.full(shape, -1), np.full(shape, FAR)
        self.square, self.q_square = (self.points**2).sum(1), (queries**2).sum(1)
        self._visit(0, np.arange(len(queries)))
        return self.d, self.at

    def _within(self, q: np.ndarray) -> np.ndarray:
        return np.minimum(self.d[q, -1], self.limit[q])

    def _offer(self, q: np.ndarray, rows: np.ndarray) -> None:
        rough = self.q_square[q][:, None] + self.square[rows][None, :] - 2 * (self.q[q] @ self.points[rows].T)
        room = 1e-12 * (self.q_square[q][:, None] + self.square[rows][None, :])  # far more than the rounding of the product
        who, what = np.nonzero(rough <= (self._within(q) ** 2 * (1 + 1e-12))[:, None] + room)
        if not len(who):
            return
        d = distances(self.q[q[who]], self.points[rows[what]])
        fine = d <= self._within(q)[who]
        who, what, d = who[fine], what[fine], d[fine]
        if not len(who):
            return
        hit, start, n = np.unique(who, return_index=True, return_counts=True)
        place = np.arange(len(who)) - np.repeat(start, n)
        row = np.repeat(np.arange(len(hit)), n)
        new_d, new_at, new_ids = np.full((len(hit), n.max()), np.inf), np.full((len(hit), n.max()), -1), np.full((len(hit), n.max()), FAR)
        new_d[row, place], new_at[row, place], new_ids[row, place] = d, rows[what], self.first[rows[what]]
        at = q[hit]
        all_d, all_at, all_ids = np.hstack([self.d[at], new_d]), np.hstack([self.at[at], new_at]), np.hstack([self.ids[at], new_ids])
        order = np.lexsort((all_ids, all_d), axis=1)[:, : self.d.shape[1]]
        self.d[at], self.at[at], self.ids[at] = (np.take_along_axis(x, order, 1) for x in (all_d, all_at, all_ids))

    def _visit(self, node: int, q: np.ndarray) -> None:
        if not len(q):
            return
        vantage, near, far = self.nodes[node].tolist()
        if vantage < 0:
            for a in range(0, len(q), 512):
                if far > near:
                    self._offer(q[a : a + 512], self.order[near:far])
            return
        self._offer(q, np.array([vantage]))
        d = distances(self.q[q], self.points[vantage])
        low, high = self.bounds[node]
        inside = d <= (low + high) / 2
        for side, other, gap, mine in ((near, far, high - d, inside), (far, near, d - low, ~inside)):
            self._visit(side, q[mine])
            self._visit(other, q[mine][self.relax * gap[mine] * (1 - 1e-12) <= self._within(q[mine])])


def search_tree(tree: VantageTree, ids: np.ndarray, starts: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, radius: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of each query's k nearest ids found within its radius, its own id left out; an id counts where it is nearest.

    ids[starts[p]:starts[p + 1]] are those at point p, ascending. k + 1 points give k ids unless some share their first id: those queries
    are asked again for twice as many points.
    """
    out: list[list] = [[], [], []]
    todo, most = np.arange(len(queries)), k + 1
    while len(todo):
        d, at = tree.nearest(queries[todo], most, radius[todo], relax)
        again = []
        for i, row in enumerate(todo.tolist()):
            found = at[i][at[i] >= 0]
            firsts = {*tree.first[found].tolist()} - {int(query_ids[row])}
            if len(found) == most and len(firsts) < k and most < len(tree.points):
                again.append(row)
                continue
            best: dict[int, float] = {}
            for dist, p in zip(d[i].tolist(), found.tolist(), strict=False):
                for j in ids[starts[p] : starts[p + 1]].tolist():
                    if j != query_ids[row]:
                        best.setdefault(j, dist)
            near = sorted((dist, j) for j, dist in best.items())[:k]
            out[0] += [row] * len(near)
            out[1] += [j for _, j in near]
            out[2] += [dist for dist, _ in near]
        todo, most = np.array(again, np.int64), 2 * most
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.float64)


class TopTree:
    """Routes vectors of one dimension to cells: nodes are (vantage vector, middle, nearer, further), leaves are cell numbers."""

    def __init__(self, sample: np.ndarray, cells: int):
        dice, self.cells = np.random.default_rng(1), 0

        def build(rows: np.ndarray, want: int):
            if want < 2 or len(rows) < 3:
                self.cells += 1
                return self.cells - 1
            vantage, near, far, low, high = _halves(sample, rows, dice)
            return sample[vantage], (low + high) / 2, build(near, (want + 1) // 2), build(far, want // 2)

        self.root = build(np.arange(len(sample)), cells)

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = np.zeros(len(vectors), np.int32)

        def walk(node, rows):
            if not len(rows):
                return
            if isinstance(node, int):
                out[rows] = node
                return
            inside = distances(vectors[rows], node[0]) <= node[1]
            walk(node[2], rows[inside])
            walk(node[3], rows[~inside])

        walk(self.root, np.arange(len(vectors)))
        return out

    def within(self, vectors: np.ndarray, radius: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that may hold a point within the radius of each vector, by the relaxed inequality."""
        found: list[tuple[np.ndarray, int]] = []

        def walk(node, rows):
            if not len(rows):
                return
            if isinstance(node, int):
                found.append((rows, node))
                return
            gap = distances(vectors[rows], node[0]) - node[1]
            room = radius[rows] + relax * 1e-12 * np.abs(node[1])
            walk(node[2], rows[relax * gap <= room])
            walk(node[3], rows[-relax * gap <= room])

        walk(self.root, np.arange(len(vectors)))
        rows = [r for r, _ in found]
        return np.concatenate(rows) if rows else np.empty(0, np.int64), np.concatenate([np.full(len(r), c, np.int32) for r, c in found]) if rows else np.empty(0, np.int32)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _by_dims(batch: pa.RecordBatch, name: str):
    """(dims, places, matrix) of the vectors of a batch."""
    sizes = batch.column("dims").to_numpy()
    for dims in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == dims)
        yield dims, places, _matrix(batch.column(name).take(pa.array(places)), dims)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part: neither null, zero nor with null or non-finite components."""
    rows = narrow(vectors, id=id_col, vector=vector_col)
    kind = rows.schema["vector"].dataType.simpleString()
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector") if kind in ("array<float>", "array<double>") else F.col("vector").cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where("id is not null and vector is not null").where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def top_trees(points: DataFrame, shard: int) -> dict[int, TopTree]:
    """For each dimension in the sample a top tree; the sample is that of the least hashes, so it does not depend on the partitions."""
    sizes = points.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(64).collect()
    out = {}
    for dims, n in sizes:  # at most 64 dimensions have a tree; all others have one cell, cut by hash like any
        cells = min(CELLS, math.ceil(n / shard))
        if cells > 1:
            rows = points.where(F.col("dims") == dims).orderBy(F.xxhash64("vector"), "first").select("vector").limit(max(2, min(SAMPLE, SAMPLE_VALUES // dims)))
            out[dims] = TopTree(np.array([r[0] for r in rows.collect()], np.float64), cells)
    return out


def _pieces(rows: DataFrame, most: int) -> dict[tuple[int, int], int]:
    """(cell, dims) -> in how many pieces its rows go, of those with more than `most`: no more entries than cells, or than rows / most."""
    counts = rows.groupBy("cell", "dims").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()
    return {(cell, dims): math.ceil(n / most) for cell, dims, n in counts}


def _piece_counts(batch: pa.RecordBatch, pieces: dict[tuple[int, int], int]) -> np.ndarray:
    return np.array([pieces.get(k, 1) for k in zip(batch.column("cell").to_pylist(), batch.column("dims").to_pylist(), strict=True)], np.int64)


def stored_trees(points: DataFrame, tops: dict[int, TopTree], shard: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """cell, dims, part, tree: one row for each shard; and the numbers of shards of the cells that have several."""
    kind = points.schema["vector"].dataType.simpleString()

    def routed(batches):
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            for dims, places, matrix in _by_dims(batch, "vector"):
                if dims in tops:
                    cells[places] = tops[dims].own(matrix)
            yield pa.RecordBatch.from_arrays([pa.array(cells), *batch.columns], ["cell", *batch.schema.names])

    placed = cut(points.mapInArrow(routed, f"cell int, vector {kind}, dims int, first long, ids array<long>"), "placed")
    parts = _pieces(placed, shard)

    def parted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(batch.column("part").to_numpy() % _piece_counts(batch, parts), pa.int32())], batch.schema.names)

    numbered = placed.select("*", F.pmod(F.xxhash64("vector", F.lit(1)), F.lit(1 << 30)).cast("int").alias("part")).mapInArrow(parted, f"cell int, vector {kind}, dims int, first long, ids array<long>, part int")

    def built(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        order = np.argsort(table.column("first").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        points_, ids = _whole(table.column("vector")), _whole(table.column("ids"))
        flat = points_.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        tree = VantageTree(flat.astype(np.float64), table.column("first").to_numpy())
        held = io.BytesIO()
        np.savez(held, points=flat, first=tree.first, nodes=tree.nodes, bounds=tree.bounds, order=tree.order, ids=ids.flatten().to_numpy(), starts=np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]))
        return pa.table({"cell": table.column("cell")[:1], "dims": table.column("dims")[:1], "part": table.column("part")[:1], "tree": pa.array([held.getvalue()], pa.binary())})

    trees = cut(numbered.groupBy("cell", "dims", "part").applyInArrow(built, "cell int, dims int, part int, tree binary"), "trees")
    drop(placed)
    return trees, parts


def _loaded(data: bytes) -> tuple[VantageTree, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        tree = VantageTree.__new__(VantageTree)
        tree.points, tree.first, tree.nodes, tree.bounds, tree.order = held["points"].astype(np.float64), held["first"], held["nodes"], held["bounds"], held["order"]
        return tree, held["ids"], held["starts"]


def _search(trees: DataFrame, parts: dict[tuple[int, int], int], asked: DataFrame, k: int, relax: float) -> DataFrame:
    """query_id, vec_id, score of what the queries (query_id, vector, dims, cell, radius) find in their cells; a block of queries goes to each shard of a cell."""
    blocks = _pieces(asked, QUERIES)
    kind = asked.schema["vector"].dataType.simpleString()

    def repeated(batches):  # each shard once for each block of its cell's queries
        for batch in batches:
            for i, n in enumerate(_piece_counts(batch, blocks).tolist()):
                for block in range(n):
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([block], pa.int32())], [*batch.schema.names, "block"])

    def sent(batches):  # each query to each shard of its cell
        for batch in batches:
            n = _piece_counts(batch, parts)
            at = np.repeat(np.arange(batch.num_rows), n)
            part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(out.column("block").to_numpy() % _piece_counts(out, blocks), pa.int32()), pa.array(part, pa.int32())], [*batch.schema.names, "part"])

    left = trees.mapInArrow(repeated, "cell int, dims int, part int, tree binary, block int")
    right = asked.select("query_id", "vector", "radius", "cell", "dims", F.pmod(F.xxhash64("query_id"), F.lit(1 << 30)).cast("int").alias("block")).mapInArrow(sent, f"query_id long, vector {kind}, radius double, cell int, dims int, block int, part int")
    keys = ["cell", "dims", "part", "block"]

    def searched(one: pa.Table, two: pa.Table) -> pa.Table:
        rows, ids, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        asking = np.empty(0, np.int64)
        if one.num_rows and two.num_rows:
            tree, of, starts = _loaded(one.column("tree")[0].as_py())
            asking = two.column("query_id").to_numpy()
            rows, ids, d = search_tree(tree, of, starts, _matrix(_whole(two.column("vector")), tree.points.shape[1]), asking, two.column("radius").to_numpy(), k, relax)
        return pa.table({"query_id": asking[rows], "vec_id": ids, "score": d})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(searched, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest ids, each where it is nearest."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, relax: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of vectors nearest to each row of queries that are found.

    score is the Euclidean distance in double precision on the original components. Ties go to the smaller id; rows with the query's own id
    are no candidates. Fewer candidates than k: all are returned. Unusable vectors (see usable) take no part on either side; vectors of
    different length are no candidates for each other. Rows that repeat an id: as candidates all their vectors count, and the id is
    returned once, with the nearest of them; as a query the least vector counts. Repeated rows count once. Empty tables give no rows.
    Only the two named columns are read, so others, whatever their names, don't matter.
    """
    held = usable(vectors, id_col, vector_col).dropDuplicates(["vector", "id"])
    first = held.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)  # cut down before the shuffle as well
    points = cut(first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("vector", F.size("vector").alias("dims"), F.get("ids", F.lit(0)).alias("first"), "ids"), "points")
    tops = top_trees(points, shard)
    trees, parts = stored_trees(points, tops, shard)
    drop(points)
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector")).select(F.col("id").alias("query_id"), "vector", F.size("vector").alias("dims"))
    kind = asked.schema["vector"].dataType.simpleString()

    def own(batches):
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            for dims, places, matrix in _by_dims(batch, "vector"):
                if dims in tops:
                    cells[places] = tops[dims].own(matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], ["query_id", "vector", "dims", "own"])

    asked = cut(asked.mapInArrow(own, f"query_id long, vector {kind}, dims int, own int"), "asked")
    near = cut(_search(trees, parts, asked.select("query_id", "vector", "dims", F.col("own").alias("cell"), F.lit(float("inf")).alias("radius")), k, relax), "near")
    if not tops:
        return _best(near, k)
    reach = _best(near, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("radius"))
    further = asked.join(reach, "query_id", "left").select("query_id", "vector", "dims", "own", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))

    def others(batches):
        for batch in batches:
            for dims, places, matrix in _by_dims(batch, "vector"):
                if dims in tops:
                    rows, cells = tops[dims].within(matrix, batch.column("radius").to_numpy()[places], relax)
                    at = places[rows]
                    new = cells != batch.column("own").to_numpy()[at]
                    part = batch.take(pa.array(at[new]))
                    yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("vector"), part.column("dims"), pa.array(cells[new]), part.column("radius")], ["query_id", "vector", "dims", "cell", "radius"])

    more = cut(further.mapInArrow(others, f"query_id long, vector {kind}, dims int, cell int, radius double"), "further")
    return _best(near.unionAll(_search(trees, parts, more, k, relax)), k)
