"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to at most unit length and given one more component that makes it exactly one, queries are scaled to
unit length; the largest inner product is then the nearest point (Bachrach et al., 2014). A table projects points on a
few random Gaussian directions, which is 2-stable, and cuts each projection into cells; a bucket is a combination of
cells. A neighbour at cosine c to the query has projections around c times the query's with variance 1 - c^2, so every
bucket has a known probability to hold it. A query visits buckets in the order of that probability, by perturbing one
cell after the other, until the probability left is small enough (Lv et al., 2007).

How small is fitted on a documented sample of queries with exact neighbours. c is a low quantile of the cosines of their
farthest neighbours; nearer ones are sought at cosines from there to one as well. The share of probability to visit is
the one that reaches all but the missing part of these neighbours. Every row is indexed.

The fit need not hold for every query. One that ends with too few rows, or whose farthest is beyond c, is compared with
all rows; and so are all queries if no share of probability reaches enough neighbours.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .base import in_workers, materialize
from .vectors import matrix, usable

TABLES = 2
#: Width of a cell, in deviations of the projection of a random point.
WIDTH = 2.0
#: Queries whose exact neighbours fit the index.
SAMPLE = 128
#: Vectors of one bucket that stay together, and parts the index is dealt into: this many, or as many as hold PART vectors each.
BLOCK, PARTS, PART = 256, 32, 8192
#: Queries scored at once.
QUERIES = 512
#: Queries compared with the same part of all rows in one task.
SCANNED = 8192
#: Cosines from c towards one at which neighbours are sought, each half as far from one as that before.
LEVELS = 4
#: Buckets a query may still visit when the probability left is that of cells this far out.
EXHAUSTED = 1e-9

normal = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), otypes=[float])


class Tables:
    """The projections of all tables."""

    def __init__(self, n: int, d: int, seed: int):
        self.k = max(2, round(math.log2(max(2, n)) / 4))
        r = np.random.default_rng(seed)
        self.directions = r.normal(size=(TABLES, d + 1, self.k))
        self.shift = r.uniform(0, WIDTH, size=(TABLES, self.k))

    def cells(self, points: np.ndarray, table: int) -> np.ndarray:
        return np.floor((points @ self.directions[table] + self.shift[table]) / WIDTH).astype(np.int64)

    def probes(self, query: np.ndarray, table: int, c: float) -> Iterator[tuple[tuple[int, ...], float]]:
        """Buckets by falling probability to hold a neighbour, each with the probability of those before it."""
        middle = c * (query @ self.directions[table]) + self.shift[table]
        deviation = np.sqrt(max(1e-6, 1 - c * c)) * np.linalg.norm(self.directions[table], axis=0) / math.sqrt(len(query))
        choices = []
        for m, s in zip(middle, deviation):
            cells = np.arange(math.floor((m - 6.5 * s) / WIDTH), math.floor((m + 6.5 * s) / WIDTH) + 1)
            p = normal(((cells + 1) * WIDTH - m) / s) - normal((cells * WIDTH - m) / s)
            order = np.argsort(-p, kind="stable")
            choices.append((p[order].tolist(), cells[order].tolist()))
        best = math.prod(p[0] for p, _ in choices)
        heap = [(-best, (0,) * len(choices), 0)]
        before = 0.0
        while heap:
            p, at, last = heapq.heappop(heap)
            yield tuple(cells[i] for i, (_, cells) in zip(at, choices)), before
            before -= p
            for j in range(last, len(choices)):
                i = at[j] + 1
                if i < len(choices[j][0]) and choices[j][0][at[j]] > 0:
                    heapq.heappush(heap, (p / choices[j][0][at[j]] * choices[j][0][i], (*at[:j], i, *at[j + 1 :]), j))

    def visits(self, query: np.ndarray, table: int, c: float, reach: float) -> dict[tuple[int, ...], float]:
        """Buckets to visit for neighbours at cosine c and nearer, each with the least share of probability that leads to it."""
        out: dict[tuple[int, ...], float] = {}
        for level in range(LEVELS):
            for cell, before in self.probes(query, table, 1 - (1 - c) / 2**level):
                if before > min(reach, 1 - EXHAUSTED):
                    break
                out[cell] = min(before, out.get(cell, 1.0))
        return out


def bucket_ids(cells: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of cells."""
    h = np.zeros(len(cells), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in cells.T:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def points(v: np.ndarray, largest: float) -> np.ndarray:
    """Rows scaled to at most unit length, with the component that makes it one."""
    scaled = v / largest
    return np.c_[scaled, np.sqrt(np.maximum(0, 1 - np.einsum("nd,nd->n", scaled, scaled)))]


def directions(v: np.ndarray) -> np.ndarray:
    """Rows of unit length with a last component of zero."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return np.c_[v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros(len(v))]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, the smaller id first among equals; -inf never counts."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    keep = keep[scores[keep] > -np.inf]
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def exact(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
    """(query position, id, score, vector) of the k best of all rows for a bounded number of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[] for _ in queries]
        for batch in batches:
            v, own = matrix(batch.column("v")), batch.column("id").to_numpy(zero_copy_only=False)
            for q in range(len(queries)) if len(v) else ():
                scores = v @ queries[q]
                scores[own == ids[q]] = -np.inf
                found[q] += [(own[i], scores[i], v[i]) for i in best(scores, own, k)]
                found[q] = sorted(found[q], key=lambda x: (-x[1], x[0]))[:k]
        flat = [(q, *x) for q, xs in enumerate(found) for x in xs]
        yield pa.RecordBatch.from_pydict(
            {"q": pa.array([x[0] for x in flat], pa.int32()), "id": pa.array([x[1] for x in flat], pa.int64()), "s": pa.array([x[2] for x in flat], pa.float64()), "v": pa.array([x[3].tolist() for x in flat], pa.list_(pa.float64()))}
        )

    found = in_workers(rows.select("id", "v"), run, "q int, id long, s double, v array<double>")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).filter(F.col("r") <= k)
    return [(r["q"], r["id"], r["s"], r["v"]) for r in found.collect()]  # SAMPLE * k rows at most


def fit(found: list[tuple], queries: np.ndarray, tables: Tables, largest: float, missing: float) -> tuple[float, float]:
    """The cosine beyond which few farthest neighbours are, and the probability to visit in every table.

    The latter is one if no visits reach enough neighbours.
    """
    if not found:
        return 0.5, 1.0
    turned = directions(queries)
    near = points(np.array([x[3] for x in found]), largest)
    q = np.array([x[0] for x in found])
    cosine = np.einsum("nd,nd->n", turned[q], near)
    farthest = {i: cosine[q == i].min() for i in np.unique(q)}
    c = float(np.clip(np.quantile(list(farthest.values()), missing, method="lower"), 0.0, 0.999))
    needed = np.ones(len(found))
    for table in range(TABLES):
        cells = tables.cells(near, table)
        for i in farthest:
            reached = tables.visits(turned[i], table, c, 1.0)
            for k in np.flatnonzero(q == i):
                needed[k] = min(needed[k], reached.get(tuple(cells[k].tolist()), 1.0))
    needed[[farthest[i] < c for i in q]] = 0.0  # such queries are compared with all rows
    return c, float(np.quantile(needed, 1 - missing, method="higher"))


def scan(rows: DataFrame, asked: DataFrame, n: int, m: int, k: int) -> DataFrame:
    """(query_id, id, score): the k best of every part of all n rows for the m rows of ``asked``, in blocks bounded on both sides."""
    parts, blocks = max(PARTS, n // PART), max(1, -(-m // SCANNED))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            v, ids = matrix(left.column("v")), left.column("id").to_numpy()
            for start in range(0, right.num_rows, QUERIES):
                some = right.slice(start, QUERIES)
                own = some.column("id").to_numpy()
                for q, s in zip(own, matrix(some.column("v")) @ v.T):
                    s[ids == q] = -np.inf
                    out += [(q, ids[i], s[i]) for i in best(s, ids, k)]
        return as_table(out)

    hashed = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select("id", "v", hashed(parts, 1).alias("part"), numbers(blocks).alias("block")).groupBy("part", "block")
    right = asked.select("id", "v", hashed(blocks, 2).alias("block"), numbers(parts).alias("part")).groupBy("part", "block")
    return left.cogroup(right).applyInArrow(rank, "query_id long, id long, score double")


def as_table(out: list[tuple]) -> pa.Table:
    columns = list(zip(*out)) or [(), (), ()]
    kinds = pa.int64(), pa.int64(), pa.float64()
    return pa.table({name: pa.array(x, t) for name, x, t in zip(("query_id", "id", "score"), columns, kinds)})


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, missing: float = 0.03, seed: int = 0
) -> DataFrame:
    """(query_id, rank, id, score): for every row whose id is divisible by ``every``, its k rows of largest inner product.

    Rows are ranked by inner product in doubles, ties by the smaller id, among all rows with other ids. ``missing`` is the
    part of the neighbours that may be missed. Vectors that take no part (see ``usable``) and rows with a null id are
    neither queries nor candidates. Rows with the same id count once, with their largest vector by components. Queries
    with fewer than k candidates get all of them. Ids must be integers; other columns are not carried along.
    """
    valid = usable(rows, id_col, vector_col).filter("id IS NOT NULL AND v IS NOT NULL")
    valid = valid.select(F.col("id").cast("long"), "v").groupBy("id").agg(F.max("v").alias("v"))
    valid = materialize(valid, "vectors")
    n, d, largest = valid.agg(F.count("*"), F.max(F.size("v")), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    tables = Tables(n, d, seed)
    asked = valid.filter(F.col("id") % every == 0)
    sample = asked.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).collect()
    queries = np.array([r["v"] for r in sample]).reshape(-1, d)
    c, reach = fit(exact(valid, np.array([r["id"] for r in sample]), queries, k), queries, tables, largest, missing)
    ship_package(rows.sparkSession)
    if reach >= 1:
        return ranked(scan(valid, asked, n, asked.count(), k), k).withColumnRenamed("id", id_col)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = points(matrix(batch.column("v")), largest) if batch.num_rows else np.zeros((0, d + 1))
            for table in range(TABLES):
                own = [pa.array(np.full(len(at), table, np.int32)), pa.array(bucket_ids(tables.cells(at, table)))]
                yield pa.RecordBatch.from_arrays([*own, batch.column("id"), batch.column("v")], ["table", "bucket", "id", "v"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = directions(matrix(batch.column("v"))) if batch.num_rows else ()
            for i, query in zip(batch.column("id").to_pylist(), turned):
                for table in range(TABLES):
                    visited = list(tables.visits(query, table, c, reach))
                    size = len(visited)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, table, np.int32)), pa.array(bucket_ids(np.array(visited, np.int64))), pa.array(np.full(size, i, np.int64))],
                        ["table", "bucket", "query"],
                    )

    parts = max(PARTS, TABLES * n // PART)
    index = valid.mapInArrow(indexed, "table int, bucket long, id long, v array<double>")
    sizes = materialize(index.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "buckets")
    part = F.pmod(F.xxhash64("table", "bucket", "block"), F.lit(parts)).cast("int")
    # a large bucket is cut into blocks, which are dealt over the parts like buckets
    dealt = index.join(sizes, ["table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("part", part)
    visits = asked.mapInArrow(probing, "table int, bucket long, query long").join(sizes, ["table", "bucket"])
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", part)
    visits = visits.groupBy("query", "part").agg(F.collect_list(F.xxhash64("table", "bucket")).alias("buckets"))
    visits = visits.join(asked.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            v, ids = matrix(left.column("v")), left.column("id").to_numpy()
            names, where = np.unique(left.column("bucket").to_numpy(), return_inverse=True)
            for start in range(0, right.num_rows, QUERIES):
                some = right.slice(start, QUERIES)
                own = some.column("query").to_numpy()
                seen = np.zeros((len(own), len(names)), dtype=bool)
                lists = some.column("buckets").combine_chunks()
                flat = lists.flatten().to_numpy()
                at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                of = np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy())
                seen[of[names[at] == flat], at[names[at] == flat]] = True
                scores = matrix(some.column("q")) @ v.T
                for q in range(len(own)):
                    s = np.where(seen[q][where] & (ids != own[q]), scores[q], -np.inf)
                    out += [(own[q], ids[i], s[i]) for i in best(s, ids, k)]
        return as_table(out)

    # both tables of a bucket meet in one number, so that a part can hold buckets of either
    left = dealt.select("part", F.xxhash64("table", "bucket").alias("bucket"), "id", "v").groupBy("part")
    found = left.cogroup(visits.select("part", "query", "buckets", "q").groupBy("part")).applyInArrow(rank, "query_id long, id long, score double")
    settled = materialize(ranked(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k), "found")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    worst = settled.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    # NaN compares as the largest number
    close = (F.col("n") >= min(k, n - 1)) & ~F.isnan("worst") & (F.col("worst") >= (c - 1e-9) * largest * length)
    unsettled = materialize(asked.join(worst, "id", "left").filter(~F.coalesce(close, F.lit(False))).select("id", "v"), "open")
    if m := unsettled.count():
        settled = settled.join(unsettled.select(F.col("id").alias("query_id")), "query_id", "left_anti")
        settled = settled.unionByName(ranked(scan(valid, unsettled, n, m, k), k))
    return settled.withColumnRenamed("id", id_col)
