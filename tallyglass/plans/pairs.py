"""All pairs of unit vectors whose cosine reaches a threshold, found exactly.

Identical vectors are folded into one representative with a copy count. Every representative
has a home cell, that of its nearest pivot, and is also sent to the lower-numbered cells that could
hold a partner: if |a - b| <= e, then b lies no more than 2e further from a's pivot than from
its own (triangle inequality), so no pair is lost. Where the threshold is so low that every cell could hold
one, there is a single cell. Cells larger than ``block_rows`` are cut into blocks and the block pairs become
separate groups, so a crowded cell is shared by many tasks and a group never exceeds two blocks. A larger table has
a fixed number of blocks until these reach ``BLOCK_BYTES``, so that its rows are copied as often whatever its size.
A task computes a bounded part of its cosines at a time. What leaves it is the pairs above the threshold, or of all
its pairs a count per histogram bin.

:func:`partners_and_roots`, which gives the number of partners of each row and links, sends no vector to a meeting: blocks are
stored once, packed, and every two of them are read where they meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .joins import salted_join
from .sampling import key_hash

#: Rows of a block at least (and of every block of a small table), blocks of a larger table, and bytes of a block's vectors at most.
BLOCK_ROWS, BLOCKS, BLOCK_BYTES = 2048, 8, 64 << 20
MAX_PIVOTS = 256
#: Cosines computed at a time, and rows that go to cells at a time.
COSINES_AT_ONCE, PLACED_AT_ONCE = 1 << 21, 8192
# Widens the cell test beyond the rounding error of float distances.
SLACK = 1e-6


def fold_copies(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """One row per distinct vector: its smallest id and how many rows carry it."""
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(id_col).alias("rep"), F.col(vec).cast("array<double>").alias("vec"))
    return rows.groupBy("vec").agg(F.min("rep").alias("rep"), F.count("*").alias("copies"))


def copy_links(df: DataFrame, folded: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(representative, copy, copies) for every row whose vector an earlier id already has."""
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    linked = salted_join(rows, folded.filter("copies > 1"), ["vec"], ["id"])
    return linked.filter("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), "copies")


def rows_of_block(rows: int, width: int) -> int:
    return min(max(BLOCK_ROWS, math.ceil(rows / BLOCKS)), max(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))


def size_of(folded: DataFrame) -> tuple[int, int]:
    """Rows, and components of a vector."""
    return tuple(folded.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first())


def similar_representatives(
    folded: DataFrame, threshold: float, block_rows: int | None = None, pivots: int | None = None
) -> DataFrame:
    """(id_a, id_b, similarity, copies_a, copies_b) over distinct unit vectors, id_a < id_b."""
    kind = folded.schema["rep"].dataType.simpleString()
    schema = f"id_a {kind}, id_b {kind}, similarity double, copies_a long, copies_b long"
    return _met(folded, threshold, block_rows, pivots, _pairs, schema)


def similarity_counts(
    folded: DataFrame, threshold: float, bins: int, block_rows: int | None = None, pivots: int | None = None
) -> tuple[DataFrame, float | None, float | None]:
    """(bin, weight) of all row pairs at or above ``threshold``, copies among them, and the ends of the equal-width bins.

    The pairs are gone through twice, for the ends and for the bins, as there may be far too many to be kept.
    """
    copies = folded.filter("copies > 1").agg(F.sum(F.expr("copies * (copies - 1) div 2")).alias("pairs")).first().pairs or 0
    ends = _met(folded, threshold, block_rows, pivots, _ends, "low double, high double").agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    found = [x for x in (*ends, 1.0 if copies else None) if x is not None]
    if not found:
        return folded.sparkSession.createDataFrame([], "bin long, weight long"), None, None
    low, high = min(found), max(found)
    counted = _met(folded, threshold, block_rows, pivots, _binned(low, high, bins), "bin long, weight long")
    at_one = int(bin_of(np.ones(1), low, high, bins)[0])
    alike = folded.sparkSession.createDataFrame([(at_one, copies)], "bin long, weight long")
    return counted.unionByName(alike).groupBy("bin").agg(F.sum("weight").alias("weight")), low, high


#: More than float vectors of length 1 can change a cosine.
FLOAT_ERROR = 4e-6
#: Bytes of the vectors of a block that is stored at most.
STORED_BYTES = 8 << 20
#: Centres that the rows of a block are sorted around, rows these are fitted on, and rows that are compared together.
CENTRES, FITTED_ON, CUT_ROWS = 4, 4096, 256
#: Cosines of stored blocks computed at a time, so few that they stay in the cache, and pairs compared once more at a time.
COMPARED_AT_ONCE, UNSURE_AT_ONCE = 1 << 18, 8192
# Widens the test of angles beyond the rounding error of floats.
ANGLE_SLACK = 2e-3


def stored_rows(rows: int, width: int) -> int:
    """Rows of a stored block at most."""
    return min(rows_of_block(rows, width), max(BLOCK_ROWS, STORED_BYTES // (8 * max(1, width))))


def partners_and_roots(folded: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """(rep, other, links, partners) as of :func:`.bands.partners_and_forest`, but exact: every two blocks of rows meet.

    Blocks are packed and checkpointed, and a task reads the two that meet in it: a vector is shuffled once, however many
    blocks there are. What the meetings of a block have found is added up and joined once more, so that a row leaves as a line
    with its counts and mostly one link.
    """
    spark = folded.sparkSession
    ship_package(spark)
    kind = folded.schema["rep"].dataType.simpleString()
    total, width = size_of(folded)
    schema = f"rep {kind}, other {kind}, links long, partners long"
    if not total:
        return spark.createDataFrame([], schema)
    block_rows = block_rows or stored_rows(total, width)
    # dealt out, as a block ends with its partition and what is held at once follows the blocks of a partition
    dealt = folded.select("rep", F.col("vec").cast("array<double>").alias("vec"), "copies").repartition(math.ceil(total / block_rows))
    packed = dealt.mapInArrow(_packer(block_rows + block_rows // 4), f"ids array<{kind}>, copies array<long>, vectors binary")
    packed = packed.select(F.monotonically_increasing_id().alias("block"), "*").checkpoint()
    # only one of them gets new names, as each row is copied for these
    others = packed.select(*[F.col(c).alias(f"other_{c}") for c in packed.columns])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _meeting(Stored(batch, row), Stored(batch, row, "other_"), threshold)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _together(batches)

    pairs = packed.hint("shuffle_replicate_nl").join(others.hint("shuffle_replicate_nl"), F.col("block") <= F.col("other_block"))
    met = pairs.mapInArrow(meet, f"block long, ids array<{kind}>, links array<long>, partners array<long>, led array<{kind}>, roots array<{kind}>")
    return met.groupBy("block").applyInArrow(together, schema)


def _packer(block_rows: int):
    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, copies, vectors = (pa.concat_arrays([b.column(c) for b in held]) for c in ("rep", "copies", "vec"))
        columns = [pa.ListArray.from_arrays([0, len(c)], c) for c in (ids, copies)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([vectors.flatten().to_numpy().tobytes()], pa.binary())], ["ids", "copies", "vectors"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                held.append(batch.slice(start, block_rows - n))
                start, n = start + held[-1].num_rows, n + held[-1].num_rows
                if n == block_rows:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return pack


class Stored:
    """A packed block."""

    def __init__(self, batch: pa.RecordBatch, row: int, prefix: str = ""):
        block, ids, copies, vectors = (batch.column(f"{prefix}{c}")[row] for c in ("block", "ids", "copies", "vectors"))
        self.block, self.ids, self.copies = block.as_py(), ids.values, copies.values.to_numpy()
        self.x = np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(self.ids), -1)
        self.links, self.partners = (np.zeros(len(self.ids), dtype=np.int64) for _ in range(2))

    def add(self, at: np.ndarray, copies: np.ndarray) -> None:
        """Partners of the rows ``at``."""
        self.links += np.bincount(at, minlength=len(self.ids))
        self.partners += np.bincount(at, copies, len(self.ids)).astype(np.int64)

    def found(self, led: pa.Array, roots: pa.Array) -> pa.RecordBatch:
        some = np.flatnonzero(self.links)
        lists = [self.ids.take(pa.array(some)), pa.array(self.links[some]), pa.array(self.partners[some]), led, roots]
        columns = [pa.array([self.block]), *(pa.ListArray.from_arrays([0, len(c)], c) for c in lists)]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "links", "partners", "led", "roots"])


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def cuts_of(x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Centres of unit vectors, and groups of their rows with the least and largest angles to each centre."""
    some = x[:: math.ceil(len(x) / FITTED_ON)]
    centres = some[np.linspace(0, len(some) - 1, CENTRES).astype(int)].copy()
    for _ in range(8):
        nearest = (some @ centres.T).argmax(axis=1)
        for k in range(CENTRES):
            along = some[nearest == k].sum(axis=0)
            if along.any():
                centres[k] = along / np.linalg.norm(along)
    apart = angles(x, centres)
    nearest = apart.argmin(axis=1)
    order, cuts = np.lexsort((apart.min(axis=1), nearest)), []
    for k in range(CENTRES):
        own = order[nearest[order] == k]
        for rows in (own[start : start + CUT_ROWS] for start in range(0, len(own), CUT_ROWS)):
            cuts.append((rows, apart[rows].min(axis=0), apart[rows].max(axis=0)))
    return centres, cuts


def similar_rows(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers in ``x`` and ``y``, unit vectors, of all pairs at or above ``threshold``, and their cosines, by and by.

    Angles to a centre differ by the angle of a pair at most, so a group of rows only meets those whose angles lie near its own.
    """
    reach = math.acos(max(-1.0, min(1.0, threshold))) + ANGLE_SLACK
    centres, cuts = cuts_of(y)
    apart = angles(x, centres)
    held, n = [], 0
    for rows, low, high in cuts:
        near = np.flatnonzero(((apart >= low - reach) & (apart <= high + reach)).all(axis=1))
        others = y[rows].T.copy()
        step = max(1, COMPARED_AT_ONCE // len(rows))
        for own in (near[start : start + step] for start in range(0, len(near), step)):
            cosines = (x[own] @ others).ravel()
            hit = np.flatnonzero(cosines >= threshold)
            held.append((own[hit // len(rows)], rows[hit % len(rows)], cosines[hit]))
            n += len(hit)
            if n >= COMPARED_AT_ONCE:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _meeting(one: Stored, two: Stored, threshold: float) -> Iterator[pa.RecordBatch]:
    """What the pairs of two blocks, or of one with itself, say about each of them.

    The vectors meet as floats, which takes half the time. The few pairs that these leave open, within ``FLOAT_ERROR`` of the
    threshold, are compared by the vectors as they are.
    """
    same, n = one.block == two.block, len(one.ids)
    two = one if same else two
    x = one.x.astype(np.float32)
    labels = np.arange(n if same else n + len(two.ids))
    for a, b, cosines in similar_rows(x, x if same else two.x.astype(np.float32), threshold - FLOAT_ERROR):
        sure = cosines >= threshold + FLOAT_ERROR
        if same:
            a, b, sure = (c[a < b] for c in (a, b, sure))
        unsure = np.flatnonzero(~sure)
        for some in (unsure[start : start + UNSURE_AT_ONCE] for start in range(0, len(unsure), UNSURE_AT_ONCE)):
            # added up one by one, as the sum of an array in Spark
            sure[some] = np.cumsum(one.x[a[some]] * two.x[b[some]], axis=1)[:, -1] >= threshold
        a, b = a[sure], b[sure]
        one.add(a, two.copies[b])
        two.add(b, one.copies[a])
        labels = join_labels(labels, a, b if same else n + b)
    ids = one.ids if same else pa.concat_arrays([one.ids, two.ids])
    led = np.flatnonzero(labels != np.arange(len(labels)))
    for side, some in ((one, led[led < n]), (two, led[led >= n])):
        if len(some) or side.links.any():
            yield side.found(ids.take(pa.array(some)), ids.take(pa.array(labels[some])))
        if same:
            break


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line with the counts of each row of a block, and links without a cycle between all it has links with."""
    parts: dict[str, list[pa.Array]] = {c: [] for c in ("ids", "led", "roots", "links", "partners")}
    for batch in batches:
        for name, part in parts.items():
            part.append(batch.column(name).flatten())
    joined = {name: pa.concat_arrays(part) for name, part in parts.items()}
    coded = pa.concat_arrays([joined[c] for c in ("ids", "led", "roots")]).dictionary_encode()
    rows, led, roots = np.split(coded.indices.to_numpy(), np.cumsum([len(joined[c]) for c in ("ids", "led")]))
    links, partners = (np.zeros(len(coded.dictionary), dtype=np.int64) for _ in range(2))
    for counts, name in ((links, "links"), (partners, "partners")):
        np.add.at(counts, rows, joined[name].to_numpy())
    labels = join_labels(np.arange(len(links)), led, roots)
    some, pointing = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(labels)))
    nothing = np.zeros(len(pointing), dtype=np.int64)
    for at, other, *counts in ((some, pa.nulls(len(some), coded.type.value_type), links[some], partners[some]), (pointing, coded.dictionary.take(pa.array(labels[pointing])), nothing, nothing)):
        columns = [coded.dictionary.take(pa.array(at)), other, *(pa.array(c) for c in counts)]
        yield pa.RecordBatch.from_arrays(columns, ["rep", "other", "links", "partners"])


def _met(folded: DataFrame, threshold: float, block_rows: int | None, pivots: int | None, handed_on: Callable, schema: str) -> DataFrame:
    """What ``handed_on`` makes of the pairs at or above ``threshold`` of every two blocks that meet."""
    spark = folded.sparkSession
    ship_package(spark)
    rows = folded.select("rep", "vec", "copies")
    total, width = size_of(rows)
    block_rows = block_rows or rows_of_block(total, width)
    reach = 2.0 * math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + SLACK
    # two unit vectors are never further than 2 apart
    wanted = pivots or (1 if reach >= 2 else max(1, min(MAX_PIVOTS, math.ceil(total / block_rows))))
    id_type = folded.schema["rep"].dataType.simpleString()
    if not total:
        return spark.createDataFrame([], schema)
    if wanted > 1:
        sample = rows.orderBy(key_hash(["rep"]), "rep").limit(wanted).select("vec").collect()
        centres = np.array([r.vec for r in sample], dtype=float).reshape(len(sample), -1)
        placed = rows.withColumn("vec", F.col("vec").cast("array<double>")).mapInPandas(_placer(centres, reach), f"id {id_type}, vec array<double>, copies long, cell int, home boolean")
        # At most one row per pivot.
        found = placed.groupBy("cell").agg(F.count_if(F.col("home")).alias("homes"), F.count_if(~F.col("home")).alias("guests"))
        loads = {r.cell: (r.homes, r.guests) for r in found.collect()}
    else:
        placed = rows.select(F.col("rep").alias("id"), "vec", "copies", F.lit(0).alias("cell"), F.lit(True).alias("home"))
        loads = {0: (total, 0)}
    entries = []
    for cell, load in loads.items():
        entries += [F.lit(cell), F.array(*[F.lit(n) for n in _block_counts(load, block_rows)])]
    counts = F.create_map(*entries)
    own = F.element_at(counts[F.col("cell")], F.when(F.col("home"), 1).otherwise(2))
    block = F.pmod(F.xxhash64("id", F.lit(7)), own).cast("int")
    homes_n, guests_n = F.element_at(counts[F.col("cell")], 1), F.element_at(counts[F.col("cell")], 2)
    # A home block meets every home block once (i <= j) and every guest block; a guest block meets every home block.
    with_homes = F.transform(
        F.sequence(F.lit(0), homes_n - 1),
        lambda j: F.struct(F.lit(0).alias("kind"), F.least(block, j).alias("i"), F.greatest(block, j).alias("j")),
    )
    with_guests = F.when(guests_n == 0, F.array().cast("array<struct<kind:int,i:int,j:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(guests_n - 1, F.lit(0))), lambda j: F.struct(F.lit(1).alias("kind"), block.alias("i"), j.alias("j")))
    )
    as_guest = F.transform(
        F.sequence(F.lit(0), F.greatest(homes_n - 1, F.lit(0))), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), block.alias("j"))
    )
    meetings = F.when(F.col("home"), F.concat(with_homes, with_guests)).when(homes_n > 0, as_guest)
    sent = placed.select("id", "vec", "copies", "cell", "home", block.alias("block"), F.explode(meetings).alias("m"))
    tasks = sent.select("id", "vec", "copies", "home", "block", "cell", "m.kind", "m.i", "m.j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(batches)
        yield from handed_on(block, block.pairs(threshold))

    return tasks.groupBy("cell", "kind", "i", "j").applyInArrow(meet, schema)


class Block:
    """The rows of two blocks that meet, or of one that meets itself."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        ids, vectors, copies, sides = [], [], [], []
        for batch in batches:
            if batch.num_rows:
                kind, i, j = (batch.column(c)[0].as_py() for c in ("kind", "i", "j"))
                ids.append(batch.column("id"))
                vectors.append(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                copies.append(batch.column("copies").to_numpy(zero_copy_only=False))
                home = batch.column("home").to_numpy(zero_copy_only=False)
                sides.append(home if kind else batch.column("block").to_numpy() == i)
        self.ids, self.x, self.copies = pa.concat_arrays(ids), np.concatenate(vectors), np.concatenate(copies)
        vectors.clear()
        left = np.concatenate(sides)
        # places in the order of ids
        self.place = np.empty(len(left), dtype=np.int64)
        self.place[np.argsort(self.ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(left))
        self.same = not kind and i == j
        self.left, self.right = np.flatnonzero(left), np.flatnonzero(left if self.same else ~left)

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of the rows of all pairs at or above ``threshold``, the smaller id first, and their cosines."""
        others = self.x[self.right]
        step = max(1, COSINES_AT_ONCE // max(1, len(others)))
        for start in range(0, len(self.left), step):
            own = self.left[start : start + step]
            after = start if self.same else 0
            cosines = self.x[own] @ others[after:].T
            hit = cosines >= threshold
            if self.same:
                hit &= np.arange(len(own))[:, None] < np.arange(hit.shape[1])[None, :]
            a, b = np.nonzero(hit)
            if len(a):
                one, two = own[a], self.right[after + b]
                turned = self.place[one] > self.place[two]
                yield np.where(turned, two, one), np.where(turned, one, two), cosines[a, b]


def _pairs(block: Block, found) -> Iterator[pa.RecordBatch]:
    for a, b, cosines in found:
        columns = [block.ids.take(pa.array(a)), block.ids.take(pa.array(b)), pa.array(cosines), pa.array(block.copies[a]), pa.array(block.copies[b])]
        yield pa.RecordBatch.from_arrays(columns, ["id_a", "id_b", "similarity", "copies_a", "copies_b"])


def _ends(block: Block, found) -> Iterator[pa.RecordBatch]:
    ends = [(cosines.min(), cosines.max()) for _, _, cosines in found]
    if ends:
        low, high = min(e[0] for e in ends), max(e[1] for e in ends)
        yield pa.RecordBatch.from_pydict({"low": pa.array([min(low, 1.0)]), "high": pa.array([min(high, 1.0)])})


def bin_of(x: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    """As :func:`..functions.binning.equal_width_bin`."""
    return np.zeros(len(x), dtype=np.int64) if low == high else np.minimum(bins - 1, np.floor((x - low) / (high - low) * bins)).astype(np.int64)


def _binned(low: float, high: float, bins: int):
    def counted(block: Block, found) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(bins, dtype=np.int64)
        for a, b, cosines in found:
            np.add.at(weights, bin_of(np.minimum(cosines, 1.0), low, high, bins), block.copies[a] * block.copies[b])
        some = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(some), "weight": pa.array(weights[some])})

    return counted


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining ``a`` with ``b``; a label is the smallest number of its group."""
    while True:
        one, two = labels[a], labels[b]
        apart = one != two
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _block_counts(load: tuple[int, int], block_rows: int) -> tuple[int, int]:
    return math.ceil(load[0] / block_rows), math.ceil(load[1] / block_rows)


def _placer(centres: np.ndarray, reach: float):
    def place(batches):
        for whole in batches:
            # a row may go to every cell
            step = max(1, PLACED_AT_ONCE // len(centres))
            for pdf in (whole.iloc[start : start + step] for start in range(0, len(whole), step)):
                x = np.vstack(pdf["vec"].to_numpy())
                gap = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * x @ centres.T
                far = np.sqrt(np.maximum(gap, 0.0))
                home = far.argmin(axis=1)
                near = far - far[np.arange(len(x)), home][:, None] <= reach
                near &= np.arange(len(centres))[None, :] <= home[:, None]
                row, cell = np.nonzero(near)
                yield pd.DataFrame(
                    {
                        **{name: pdf[c].to_numpy()[row] for name, c in (("id", "rep"), ("vec", "vec"), ("copies", "copies"))},
                        "cell": cell,
                        "home": cell == home[row],
                    }
                )

    return place


#: Cells of :func:`extreme_pairs` at most, rows a cell holds on average in smaller tables, and rows its centres are chosen from.
MOST_CELLS, CELL_ROWS, CENTRE_SAMPLE = 1024, 256, 8192
#: Cell pairs opened first; each further round opens four times as many.
OPENED_FIRST = 64


def pair_bounds(centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all i <= j: i, j and bounds of the cosine of unit vectors within angle ``radii`` of the centres.

    A centre of length 0 stands for vectors of zeros, whose cosine with anything is 0.
    """
    i, j = np.triu_indices(len(centres))
    along = centres @ centres.T
    between = np.arccos(np.clip(along[i, j], -1, 1))
    spread = radii[i] + radii[j] + SLACK
    upper = np.cos(np.maximum(0, between - spread)) + SLACK
    lower = np.cos(np.minimum(math.pi, between + spread)) - SLACK
    empty = ~centres.any(axis=1)
    nothing = empty[i] | empty[j]
    return i, j, np.where(nothing, 0, lower), np.where(nothing, 0, upper)


def farthest_first(x: np.ndarray, wanted: int) -> np.ndarray:
    """Rows of ``x`` chosen so that each is as far as can be from those before it."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(wanted, len(x)) and nearest.min() < 1 - SLACK:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def extreme_pairs(
    rows: DataFrame, n: int, largest: bool = True, block_rows: int = 8192, at_once: int = 512, cells: int | None = None, opened: list | None = None
) -> DataFrame:
    """(id_a, id_b, similarity) of the n most or least similar pairs of all rows (id, vec), id_a < id_b. Vectors have length 1 or 0.

    Every row goes to its nearest centre, and the angles to it bound the cosines between two cells. Pairs of cells are
    opened in rounds, the best bound first, until the n-th best pair found beats the bounds of all others: clustered
    data open a small part, data without any structure all of them. A cell is cut into blocks, every two blocks meet in one
    task, and a task hands on its n best pairs only. Cosines are compared to 12 digits, since equal ones may differ behind
    these; ties are ordered by id. ``opened``, if given, gets the number of cell pairs of each round and of all.
    """
    spark = rows.sparkSession
    ship_package(spark)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id_a {id_type}, id_b {id_type}, similarity double"
    total = rows.count()
    wanted = cells or max(1, min(MOST_CELLS, math.ceil(total / CELL_ROWS)))
    nonzero = F.exists("vec", lambda v: v != 0)
    sample = rows.filter(nonzero).orderBy(key_hash(["id"]), "id").limit(min(CENTRE_SAMPLE, 16 * wanted)).select("vec").collect()
    if total < 2:
        return spark.createDataFrame([], schema)
    width = len(sample[0].vec) if sample else 1
    chosen = farthest_first(np.array([r.vec for r in sample], dtype=float), wanted) if sample else np.zeros((0, width))
    # the last cell is for vectors of zeros
    centres = np.vstack([chosen, np.zeros((1, width))])

    def place(batches):
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["vec"].to_numpy())
                along = np.where(x.any(axis=1)[:, None], x @ centres[:-1].T, -2.0) if len(centres) > 1 else np.full((len(x), 1), -2.0)
                cell, best = along.argmax(axis=1), along.max(axis=1)
                cell = np.where(best < -1.5, len(centres) - 1, cell)
                yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "cell": cell, "angle": np.where(best < -1.5, 0, np.arccos(np.clip(best, -1, 1)))})

    placed = rows.select("id", "vec").mapInPandas(place, f"id {id_type}, vec array<double>, cell int, angle double").checkpoint()
    # at most a row per cell
    sizes = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    own = sorted(sizes)
    i, j, lower, upper = pair_bounds(centres[own], np.array([sizes[c].radius for c in own]))
    i, j = np.array(own)[i], np.array(own)[j]
    order = np.argsort(-upper if largest else lower, kind="stable")
    order = np.array([k for k in order if i[k] != j[k] or sizes[i[k]].n > 1], dtype=int)
    blocks = {c: math.ceil(sizes[c].n / block_rows) for c in own}
    block_of = F.create_map(*[F.lit(x) for c in own for x in (c, blocks[c])])

    def first(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["similarity", "id_a", "id_b"], ascending=[not largest, True, True]).head(n)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        home, guest = (pdf.loc[pdf["side"] == s].reset_index(drop=True) for s in (0, 1))
        same = len(guest) == 0 and bool(pdf["same"].iloc[0])
        guest = home if same else guest
        out = pd.DataFrame({"id_a": pdf["id"].iloc[:0], "id_b": pdf["id"].iloc[:0], "similarity": np.zeros(0)})
        if not len(home) or not len(guest):
            return out
        ids, others = home["id"].to_numpy(), guest["id"].to_numpy()
        x, y = np.vstack(home["vec"].to_numpy()), np.vstack(guest["vec"].to_numpy())
        for start in range(0, len(x), at_once):
            score = np.round(x[start : start + at_once] @ y.T, 12) * (1 if largest else -1)
            some = ids[start : start + at_once]
            if same:
                score[some[:, None] >= others[None, :]] = -np.inf
            least = np.partition(score.ravel(), -n)[-n] if score.size > n else -np.inf
            a, b = np.nonzero((score >= least) & (score > -np.inf))
            u, v = some[a], others[b]
            found = pd.DataFrame({"id_a": np.where(u < v, u, v), "id_b": np.where(u < v, v, u), "similarity": score[a, b] * (1 if largest else -1)})
            out = first(pd.concat([out, first(found)])) if len(out) else first(found)
        return out

    best, at, size = [], 0, OPENED_FIRST
    found = spark.createDataFrame([], schema)
    while at < len(order):
        ahead = order[at : at + size]
        if len(best) == n:
            ahead = ahead[upper[ahead] >= best[-1].similarity if largest else lower[ahead] <= best[-1].similarity]
            if not len(ahead):
                break
        some, at, size = ahead, at + len(ahead), size * 4
        visits = pd.DataFrame({"pair": some, "i": i[some], "j": j[some]})
        # at most MOST_CELLS squared / 2 pairs of three numbers
        visits = F.broadcast(spark.createDataFrame(visits.astype("int64"), "pair long, i int, j int"))
        count = block_of[F.col("cell")]
        block = F.pmod(F.xxhash64("id", F.lit(11)), count).cast("int")
        # within a cell, block p meets block q >= p; between two cells, every block of one meets every block of the other
        upto = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
        homes = placed.join(visits, F.col("cell") == F.col("i")).withColumn("p", block).withColumn("q", upto(block_of[F.col("j")]))
        homes = homes.withColumn("side", F.lit(0)).filter("i <> j OR q >= p")
        guests = placed.join(visits, F.col("cell") == F.col("j")).withColumn("q", block).withColumn("p", upto(block_of[F.col("i")]))
        guests = guests.withColumn("side", F.lit(1)).filter("i <> j OR p < q")
        columns = ["id", "vec", "side", "pair", "p", "q", F.expr("i = j AND p = q").alias("same")]
        sent = homes.select(*columns).unionByName(guests.select(*columns))
        found = found.unionByName(sent.groupBy("pair", "p", "q").applyInPandas(match, schema))
        ranked = found.orderBy(F.desc("similarity") if largest else F.asc("similarity"), "id_a", "id_b").limit(n)
        best = ranked.collect()  # n rows
        found = spark.createDataFrame(best, schema)
    if opened is not None:
        opened += [min(at, len(order)), len(order)]
    return found
