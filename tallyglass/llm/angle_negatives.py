"""Hard negatives by angular triangle filtering.

Every row stores its length and its angles to a few reference directions. The angle between two vectors is at least the
difference of their angles to a reference and at most their sum (or what that lacks to a full turn), so the references give
an interval for its cosine and, times both lengths, for the score. The bounds are widened by more than rounding can
amount to; rows whose interval misses the window of wanted scores are dropped, all others are scored in whole numbers.

Anchors meet rows in blocks of bounded size on both sides. For the positives the blocks hold one label, and the window is
all above the best scores so far. For the negatives they hold rows near one reference, and the window reaches from the
lowest bound of any positive to the highest; pairs of an anchor group and a reference whose intervals miss it are never
brought together. Every step is exact, the references only decide how much is scored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from collections.abc import Iterator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import salted_join
from ..session import ship_package
from .base import in_workers, materialize, pick
from .vectors import as_lists, matrix

#: Reference directions, and the rows (by hash) they are fitted on.
REFERENCES, SAMPLE = 16, 4096
#: Most rows and anchors in a block, and the number of blocks smaller tables are cut into.
ROWS, ANCHORS, BLOCKS, LEAST = 16_384, 8_192, 24, 1024
#: Most anchors filtered together, and rows scored at a time, the most promising ones in smaller numbers.
TILE, CHUNK, CHUNK_AT_FIRST = 32, 2048, 128
#: Angles err by less than this, since arccos loses half the digits near 0 and pi; products by less than this share.
ANGLE_ERROR, SHARE_ERROR = 1e-7, 1e-9
#: Vectors of this squared length in whole numbers, or more, take no part: their scores might not fit a long.
TOO_LONG = float(1 << 62)

SQL = """
WITH r AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.k AS a, a.vec_id AS anchor_id, x.vec_id, x.label = a.label AS same, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score
  FROM r a JOIN r x ON a.k <> x.k WHERE a.vec_id % 100 = 0
), p AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS p
  FROM s WHERE same QUALIFY p <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY a, p ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (a, anchor_id)
  WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
  QUALIFY rank <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part, v in whole numbers: see :func:`mine`."""
    rows = pick(rows, id=id_col, label=label_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.filter(F.col("label").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(1 << 31))))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.filter(squares < TOO_LONG)
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("v") == (size["size"] if size else 0))


def references(sample: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors near the directions of a sample: farthest points, then a few rounds of spherical k-means."""
    lengths = np.linalg.norm(sample, axis=1)
    unit = sample[lengths > 0] / lengths[lengths > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    chosen = [np.random.default_rng(seed).integers(len(unit))]
    nearest = unit @ unit[chosen[0]]
    while len(chosen) < REFERENCES and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    found = unit[chosen]
    for _ in range(5):
        own = (unit @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1)
        found = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], found)
    return found


def angles_to(v: np.ndarray, lengths: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ found.T / np.maximum(lengths, 1e-300)[:, None], -1, 1))


def score_bounds(angles, lengths, low_angles, high_angles, low_length, high_length) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the score of each row with any anchor whose angles and length lie in the given intervals."""
    low, high = low_angles - ANGLE_ERROR, high_angles + ANGLE_ERROR
    least = np.maximum(0, np.maximum(angles - high, low - angles).max(axis=1) - ANGLE_ERROR)
    most = np.minimum(np.minimum(angles + high, 2 * math.pi - angles - low).min(axis=1) + ANGLE_ERROR, math.pi)
    up, down = np.cos(np.minimum(least, math.pi)), np.cos(np.maximum(most, 0))
    upper = lengths * np.where(up > 0, high_length, low_length) * up
    lower = lengths * np.where(down > 0, low_length, high_length) * down
    return lower - np.abs(lower) * SHARE_ERROR - 1, upper + np.abs(upper) * SHARE_ERROR + 1


class Block:
    """Vectors of one side of a group, in order of id with nulls first, so that positions settle ties."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.rows = rows.take(pc.sort_indices(rows.column("id"), null_placement="at_start"))
        self.v = matrix(self.rows.column("v"))
        self.lengths = self.rows.column("length").to_numpy()
        self.angles = matrix(self.rows.column("angles"))
        self.keys = self.rows.column("k").to_numpy()

    def tiles(self) -> Iterator[np.ndarray]:
        """Positions of similar vectors: of one nearest reference, and in order of the angle to it."""
        nearest, angle = self.angles.argmin(axis=1), self.angles.min(axis=1)
        for reference in np.unique(nearest):
            own = np.flatnonzero(nearest == reference)
            own = own[np.argsort(angle[own], kind="stable")]
            for start in range(0, len(own), TILE):
                yield own[start : start + TILE]

    def bounds_with(self, anchors: Block, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, n = anchors.angles[tile], anchors.lengths[tile]
        return score_bounds(self.angles, self.lengths, a.min(axis=0), a.max(axis=0), n.min(), n.max())

    def scores(self, anchors: Block, tile: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whole-number scores; sums stay below the product of the lengths, and exact in doubles below 2**53."""
        q, x = anchors.v[tile], self.v[at]
        if self.lengths.max() * anchors.lengths.max() < float(1 << 52):
            return (q @ x.T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T

    def ids(self, at: list[int]) -> pa.Array:
        return self.rows.column("id").take(pa.array(at, pa.int64())).combine_chunks()


def first(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Which k come first by (score from the top, position)."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((at[some], -scores[some]))][:k]


def best_of(rows: Block, anchors: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position of an anchor, positions of its k best other rows of the block, their scores)."""
    for tile in anchors.tiles():
        lower, upper = rows.bounds_with(anchors, tile)
        n = len(upper)
        # an anchor is one of its rows itself, so k + 1 rows are sure to score this much
        sure = np.partition(lower, n - k - 1)[n - k - 1] if n > k + 1 else -np.inf
        order = np.flatnonzero(upper >= sure)
        order = order[np.argsort(-upper[order], kind="stable")]
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(tile)
        start, size = 0, CHUNK_AT_FIRST
        while start < len(order):
            at = order[start : start + size]
            if start and min(s[-1] if len(s) == k else -np.inf for _, s in kept) > upper[at[0]]:
                break
            start, size = start + size, min(2 * size, CHUNK)
            scored = rows.scores(anchors, tile, at)
            for i, a in enumerate(tile):
                other = rows.keys[at] != anchors.keys[a]
                places, scores = np.concatenate([kept[i][0], at[other]]), np.concatenate([kept[i][1], scored[i][other]])
                top = first(scores, places, k)
                kept[i] = places[top], scores[top]
        for a, (places, scores) in zip(tile, kept):
            yield a, places, scores


def below_positives(rows: Block, anchors: Block, windows: list, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(position of an anchor, number of a positive, positions of the first k rows in its window, their scores).

    ``windows``: for every anchor, its (number, lowest score, highest score).
    """
    both = pa.concat_arrays([t.rows.column("label").combine_chunks() for t in (rows, anchors)]).dictionary_encode()
    labels = both.indices.to_numpy(zero_copy_only=False)
    labels, own = labels[: len(rows.keys)], labels[len(rows.keys) :]
    for tile in anchors.tiles():
        lower, upper = rows.bounds_with(anchors, tile)
        lowest, highest = min(w[1] for a in tile for w in windows[a]), max(w[2] for a in tile for w in windows[a])
        alive = np.flatnonzero((upper >= lowest) & (lower <= highest))
        kept: dict[tuple[int, int], tuple] = {}
        for start in range(0, len(alive), CHUNK):
            at = alive[start : start + CHUNK]
            scored = rows.scores(anchors, tile, at)
            for i, a in enumerate(tile):
                other = np.flatnonzero((labels[at] != own[a]) & (scored[i] >= min(w[1] for w in windows[a])))
                other = other[np.lexsort((at[other], -scored[i][other]))]
                places, scores = at[other], scored[i][other]
                for number, low, high in windows[a]:
                    begin = np.searchsorted(-scores, -high, "left")
                    end = min(begin + k, np.searchsorted(-scores, -low, "right"))
                    if begin < end:
                        old = kept.get((a, number), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        p, s = np.concatenate([old[0], places[begin:end]]), np.concatenate([old[1], scores[begin:end]])
                        top = first(s, p, k)
                        kept[a, number] = p[top], s[top]
        for (a, number), (p, s) in kept.items():
            yield a, number, p, s


def mine(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5,
    negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, seed: int = 0,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: the hard negatives of all anchors.

    Components x count as floor(scale x). Anchors are the rows whose id is divisible by ``every``. A row's score is its inner
    product with the anchor. An anchor's positives are its first other rows of the same label, highest score first, ties by
    smaller id; to each belong the first rows of other labels with low positive_score <= 100 negative_score <= high positive_score.

    Rows take no part if their label or vector is null, a component is null or not finite, the vector is empty or of another
    length than most (the smaller of equally frequent lengths), its components times scale reach 2**31, or its squared
    length 2**62. Vectors of zeros take part with scores of 0. Every row counts as itself, so rows with the same id are
    positives, negatives and anchors of their own, and rows with a null id come before others and are no anchors. An anchor
    without positives, or a positive without rows in its window, has no line. Other columns are not carried along.
    """
    spark = rows.sparkSession
    found = whole_vectors(rows, id_col, vector_col, label_col, scale)
    kinds = {c: found.schema[c].dataType.simpleString() for c in ("id", "label")}
    order = F.xxhash64("id", F.col("v"), F.lit(seed))
    sample = [r["v"] for r in found.select("v", order.alias("o")).orderBy("o").limit(SAMPLE).collect()]
    if not sample:
        empty = f"anchor_id {kinds['id']}, positive_id {kinds['id']}, rank int, negative_id {kinds['id']}, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    directions = references(np.array(sample, dtype=float), seed)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            lengths = np.sqrt((v * v).sum(axis=1))
            angles = angles_to(v, lengths, directions)
            own = [pa.array(lengths), as_lists(angles), pa.array(angles.argmin(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "v")), *own], ["id", "label", "v", "length", "angles", "cell"])

    schema = f"id {kinds['id']}, label {kinds['label']}, v array<long>, length double, angles array<double>, cell int"
    table = materialize(in_workers(found, measured, schema).withColumn("k", F.monotonically_increasing_id()), "measured")
    is_anchor = F.coalesce(F.col("id") % every == 0, F.lit(False))
    cells = {r["cell"]: r["n"] for r in table.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per reference
    most = min(ROWS, max(LEAST, math.ceil(sum(cells.values()) / BLOCKS)))
    numbered = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    ship_package(spark)

    # positives: blocks of one label
    sizes = table.groupBy("label").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"), F.ceil(F.count_if(is_anchor) / ANCHORS).cast("int").alias("groups"))
    labelled = salted_join(table.drop("cell"), sizes.filter("groups > 0"), ["label"], ["k"])
    left = labelled.withColumn("block", numbered("k", F.col("blocks"))).withColumn("group", upto(F.col("groups")))
    right = labelled.filter(is_anchor).withColumn("group", numbered("k", F.col("groups"))).withColumn("block", upto(F.col("blocks")))
    keys = ["label", "block", "group"]

    def positives_in(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        a, ids, scores = [], [], []
        block = None
        if ours.num_rows and theirs.num_rows:
            block, anchors = Block(ours), Block(theirs)
            for i, places, s in best_of(block, anchors, positives):
                a += [anchors.keys[i]] * len(places)
                ids += places.tolist()
                scores += s.tolist()
        found = block.ids(ids) if block else ours.column("id").combine_chunks().slice(0, 0)
        return pa.table({"a": pa.array(a, pa.int64()), "id": found, "score": pa.array(scores, pa.int64())})

    # new names for the columns, as both sides come from one table
    chosen = left.groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys)).applyInArrow(positives_in, f"a long, id {kinds['id']}, score long")
    p = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), F.col("id").asc_nulls_first()))
    chosen = chosen.withColumn("p", p).filter(F.col("p") <= positives)
    chosen = materialize(chosen.select("a", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: blocks near one reference, and anchors with the windows of their positives
    window = F.struct("p", F.expr(f"CAST(ceil({low} * CAST(positive_score AS DECIMAL(38,0)) / 100) AS LONG)").alias("low"), F.expr(f"CAST(floor({high} * CAST(positive_score AS DECIMAL(38,0)) / 100) AS LONG)").alias("high"))
    windows = chosen.select("a", window.alias("w")).filter("w.low <= w.high").groupBy("a").agg(F.collect_list("w").alias("windows"))
    anchors = table.filter(is_anchor).join(windows.withColumnRenamed("a", "k"), "k")
    many = anchors.count()
    one = F.lit(0) if many <= ANCHORS else F.col("cell")
    anchors = materialize(anchors.withColumn("side", one.cast("int")), "anchors")
    extent = [f(F.col("angles")[i]).alias(f"{name}{i}") for i in range(len(directions)) for name, f in (("min", F.min), ("max", F.max))]
    extent += [F.min("length").alias("shortest"), F.max("length").alias("longest"), F.count("*").alias("n")]
    asked = [F.min(F.array_min(F.transform("windows", lambda w: w["low"]))).alias("low"), F.max(F.array_max(F.transform("windows", lambda w: w["high"]))).alias("high")]
    of_rows, of_anchors = table.groupBy("cell").agg(*extent).collect(), anchors.groupBy("side").agg(*extent, *asked).collect()  # at most a row per reference each
    meets = meeting(of_rows, of_anchors, len(directions))
    literal = lambda values: F.array(*[F.lit(x) for x in values])
    named = range(len(directions))
    blocks, groups = ([math.ceil(next((r["n"] for r in rs if r[key] == i), 0) / size) for i in named] for rs, key, size in ((of_rows, "cell", most), (of_anchors, "side", ANCHORS)))
    at = lambda values, key: F.element_at(literal(values), F.col(key) + 1)
    sides = F.array(*[F.array(*[F.lit(s) for s in named if (c, s) in meets]).cast("array<int>") for c in named])
    near = F.array(*[F.array(*[F.lit(c) for c in named if (c, s) in meets]).cast("array<int>") for s in named])
    left = table.withColumn("block", numbered("k", at(blocks, "cell"))).withColumn("side", F.explode(F.element_at(sides, F.col("cell") + 1)))
    left = left.withColumn("group", upto(at(groups, "side")))
    right = anchors.withColumn("group", numbered("k", at(groups, "side"))).withColumn("cell", F.explode(F.element_at(near, F.col("side") + 1)))
    right = right.withColumn("block", upto(at(blocks, "cell")))
    keys = ["cell", "block", "side", "group"]

    def negatives_in(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        a, numbers, ids, scores = [], [], [], []
        block = None
        if ours.num_rows and theirs.num_rows:
            block, anchors = Block(ours), Block(theirs)
            wanted = [[(w["p"], w["low"], w["high"]) for w in ws] for ws in anchors.rows.column("windows").to_pylist()]
            for i, number, places, s in below_positives(block, anchors, wanted, negatives):
                a += [anchors.keys[i]] * len(places)
                numbers += [number] * len(places)
                ids += places.tolist()
                scores += s.tolist()
        found = block.ids(ids) if block else ours.column("id").combine_chunks().slice(0, 0)
        return pa.table({"a": pa.array(a, pa.int64()), "p": pa.array(numbers, pa.int32()), "id": found, "score": pa.array(scores, pa.int64())})

    hard = left.groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys)).applyInArrow(negatives_in, f"a long, p int, id {kinds['id']}, score long")
    rank = F.row_number().over(Window.partitionBy("a", "p").orderBy(F.desc("score"), F.col("id").asc_nulls_first()))
    hard = hard.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    hard = hard.join(chosen, ["a", "p"]).join(anchors.select(F.col("k").alias("a"), F.col("id").alias("anchor_id")), "a")
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def meeting(of_rows: list, of_anchors: list, references: int) -> set[tuple[int, int]]:
    """(cell, side) pairs that may hold a score in a window, by the intervals of their angles and lengths."""
    out = set()
    for r in of_rows:
        for a in of_anchors:
            ours, theirs = ([np.array([x[f"{m}{i}"] for i in range(references)]) for m in ("min", "max")] for x in (r, a))
            # the rows of a cell lie between its extremes: a difference is smallest at the near end of the interval
            gap = np.maximum(0, np.maximum(ours[0] - theirs[1], theirs[0] - ours[1]).max() - 4 * ANGLE_ERROR)
            far = min(np.minimum(ours[1] + theirs[1], 2 * math.pi - ours[0] - theirs[0]).min() + 4 * ANGLE_ERROR, math.pi)
            up, down = math.cos(min(gap, math.pi)), math.cos(max(far, 0))
            upper = up * (r["longest"] * a["longest"] if up > 0 else r["shortest"] * a["shortest"])
            lower = down * (r["shortest"] * a["shortest"] if down > 0 else r["longest"] * a["longest"])
            slack = 1 + SHARE_ERROR * r["longest"] * a["longest"]
            if upper + slack >= a["low"] and lower - slack <= a["high"]:
                out.add((r["cell"], a["side"]))
    return out


def relabelled(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """The contract's labels: where the id is divisible by 7, (label + 1) % 10."""
    label = F.col(f"`{label_col}`")
    moved = F.coalesce(F.col(f"`{id_col}`") % 7 == 0, F.lit(False))
    return rows.withColumn(label_col, F.when(moved, (label + 1) % 10).otherwise(label))
