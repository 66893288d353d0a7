"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document is the bag of its shingles of five words. Every shingle sends arrivals of a Poisson process, at a rate of its
weight, to random registers, and a register remembers the first to arrive. Two documents agree in a register with the
probability Jaccard of their bags (Moulton and Jiang, 2018). A shingle stops when its next arrival is later than every
register's first, so long documents cost little more than their number of shingles (Ertl, 2020).

Documents that agree in all registers of a band share a bucket. Exact copies are one node from the start. In a bucket
every node is verified against one centre, drawn anew in every band. Where the nodes of a bucket then still belong to
several components, the pairs across components are tried, in blocks of bounded size and within the tasks, which hand
on spanning links only. So a bucket of n near copies costs about n verifications, and no two components stay apart that
a link between nodes of one bucket joins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .base import id_and_text, in_workers, likely, materialize, pick, pieces
from .components import components

SHINGLE = 5
#: Registers in bands: nodes of similarity 0.8 share one of 24 bands of 5 with probability 0.99993.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: A pair is verified if its share of equal registers is within this of the threshold: 4.1 standard deviations at 0.8.
SLACK = 0.15
#: Rows of a bucket in one block of the search across components.
BLOCK = 400
REMEMBERED = 300_000
GOLDEN, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
ODD = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@functools.cache
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of a text, ascending, and how often each occurs.

    Words are the lower-cased parts between white space; one to four words form a single shingle, no words none.
    """
    words = text.lower().split()
    h = np.fromiter(map(word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(h))
    if not size:
        return h, np.zeros(0, dtype=np.int64)
    n = len(h) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        total = mix(total * ODD[i] + h[i : i + n])
    return np.unique(total, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers (rows by REGISTERS) of the bags; an empty bag has zeros only."""
    n = len(bags)
    registers = np.zeros(n * REGISTERS, dtype=np.uint32)
    first = np.full(n * REGISTERS, np.inf)
    element = np.concatenate([b[0] for b in bags]) if bags else np.zeros(0, np.uint64)
    rate = np.concatenate([b[1] for b in bags]).astype(float) if bags else np.zeros(0)
    bag = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    time, state = np.zeros(len(element)), element
    latest = np.full(n, np.inf)
    step = 0
    with np.errstate(over="ignore"):
        while len(element):
            step += 1
            state = mix(state + GOLDEN)
            time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
            going = time < latest[bag]
            if not going.all():
                element, rate, bag, time, state = (x[going] for x in (element, rate, bag, time, state))
            slot = bag * REGISTERS + (mix(state ^ MIX2) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(first, slot, time)
            won = first[slot] == time
            registers[slot[won]] = (element[won] >> np.uint64(32)).astype(np.uint32)
            if step < 4 or step % 8 == 0:
                latest = first.reshape(n, REGISTERS).max(axis=1)
    return registers.reshape(n, REGISTERS)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum over all j of max(a_j / a_i, b_j / b_i)."""
    all_, inverse = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    x, y = np.zeros(len(all_)), np.zeros(len(all_))
    x[inverse[: len(a[0])]] = a[1]
    y[inverse[len(a[0]) :]] = b[1]
    if not len(all_):
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # elements of a larger or equal ratio count by a, the others by b
    at = np.searchsorted(ratio, ratio, "left")
    by_a, by_b = np.r_[np.cumsum(x[::-1])[::-1], 0.0][at], np.r_[0.0, np.cumsum(y)][at]
    common = (x > 0) & (y > 0)
    return float(np.sum(1.0 / (by_a[common] / x[common] + by_b[common] / y[common])))


def node_of(text: Column) -> Column:
    """Exact copies are one node."""
    return F.unhex(F.md5(text))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, id, signature) of the distinct texts; id is the smallest, texts without words have no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            bags = [shingles(t) for t in batch.column("text").to_pylist()]
            signed = [s.tobytes() if len(b[0]) else None for s, b in zip(signatures(bags), bags)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), pa.array(signed, pa.binary())], ["id", "node", "signature"])

    kind = rows.schema["id"].dataType.simpleString()
    signed = in_workers(rows.withColumn("node", node_of(F.col("text"))), run, f"id {kind}, node binary, signature binary")
    return signed.groupBy("node").agg(F.min("id").alias("id"), F.first("signature").alias("signature"))


def equal_registers(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(v.to_pylist()), dtype=np.uint32).reshape(-1, REGISTERS) for v in (a, b))
    return (x == y).sum(axis=1)


def bags_of(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The written (node, h, w) of the wanted nodes: shingle hashes and how often each occurs.

    The text of a node is read from the row with its smallest id, so hot groups of copies are not moved, and a bitmap of
    the ids keeps most other texts where they are.
    """

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([x.astype(kind).tobytes() for x in part], pa.binary()) for part, kind in zip(zip(*found), (np.uint64, np.uint32))]
            yield pa.RecordBatch.from_arrays([batch.column("wanted"), *columns], ["node", "h", "w"])

    wanted = materialize(wanted.join(nodes.select("node", "id"), "node"), "wanted").withColumnsRenamed({"id": "of", "node": "wanted"})
    # id and text hash together, so that null or repeated ids join each text with itself only
    keyed = rows.withColumn("own", node_of(F.col("text"))).withColumn("key", F.xxhash64("id", "own"))
    texts = likely(keyed, "key", wanted.withColumn("key", F.xxhash64("of", "wanted")), "key")
    texts = texts.groupBy("id", "own").agg(F.min("text").alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("wanted")))
    found = in_workers(texts.select("wanted", "text"), bags, "node binary, h binary, w binary")
    return materialize(found.dropDuplicates(["node"]), "bags")


def bag(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(h, np.uint64), np.frombuffer(w, np.uint32)


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of nodes whose probability Jaccard reaches the threshold."""

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = equal_registers(batch.column("x"), batch.column("y")) >= (threshold - SLACK) * REGISTERS
            yield batch.select(["a", "b"]).filter(pa.array(close))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("ha", "wa", "hb", "wb")]
            s = np.array([probability_jaccard(bag(*r[:2]), bag(*r[2:])) for r in zip(*([v.as_buffer() for v in c] for c in columns))])
            kept = batch.select(["a", "b"]).append_column("similarity", pa.array(s, pa.float64()))
            yield kept.filter(pa.array(s >= threshold, pa.bool_()))

    signed = nodes.select("node", "signature")
    both = pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a")
    both = both.join(signed.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
    close = materialize(in_workers(both, promising, "a binary, b binary"), "promising")
    found = bags_of(close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct(), nodes, rows)
    side = lambda s: found.select(F.col("node").alias(s), F.col("h").alias("h" + s), F.col("w").alias("w" + s))
    return in_workers(close.join(side("b"), "b").join(side("a"), "a"), exact, "b binary, a binary, similarity double").select("a", "b", "similarity")


def similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """Probability Jaccard of one bag with each of the others, or 0 where a bound shows that it is below the threshold.

    No summand exceeds the smaller share of the element in either bag, so their sum over common elements is a bound. Where
    no element repeats the similarity is the share of common elements.
    """
    sizes = np.array([len(h) for h, _ in others])
    h, w = (np.concatenate([o[k] for o in others]) for k in (0, 1))
    of = np.repeat(np.arange(len(others)), sizes)
    at = np.minimum(np.searchsorted(one[0], h), len(one[0]) - 1)
    common = one[0][at] == h
    at, of, w = at[common], of[common], w[common]
    totals = np.array([o[1].sum() for o in others])
    bound = np.bincount(of, np.minimum(w / totals[of], one[1][at] / one[1].sum()), len(others))
    shared = np.bincount(of, minlength=len(others))
    out = shared / (sizes + len(one[0]) - shared)
    single = (totals == sizes) & (one[1].sum() == len(one[0]))
    for i in np.flatnonzero(~single):
        out[i] = probability_jaccard(one, others[i]) if bound[i] >= threshold - 1e-9 else 0.0
    return out


def block_pairs(members: DataFrame) -> DataFrame:
    """``members`` (band, bucket, n, ...), cut into blocks and repeated for each pair of blocks (i, j) of their bucket."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumn("g", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"i": F.least("g", "other"), "j": F.greatest("g", "other")}).drop("n", "other")


def close_across(x: np.ndarray, rest: np.ndarray, band: int, threshold: float) -> np.ndarray:
    """Registers in common with each of the rest, or 0 if too few for the threshold or if an earlier band has the pair."""
    same = rest == x
    common = same.sum(axis=1)
    earlier = same[:, : band * ROWS].reshape(len(rest), band, ROWS).all(axis=2).any(axis=1)
    return np.where(earlier | (common < (threshold - SLACK) * REGISTERS), 0, common)


def sides(group: pd.DataFrame, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of block i and of block j, and the registers of all."""
    signs = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(-1, REGISTERS)
    return np.flatnonzero(group["g"] == i), np.flatnonzero(group["g"] == j), signs


def across(members: DataFrame, nodes: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Spanning links (a, b) between components within the buckets of ``members`` (band, bucket, node, root, n)."""

    def suspects(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        band, bucket, i, j = key
        left, right, signs = sides(group, i, j)
        root = pd.factorize(group["root"])[0]
        found = np.zeros(len(group), dtype=bool)
        for k in left:
            near = right[(close_across(signs[k], signs[right], band, threshold) > 0) & (root[right] != root[k])]
            found[near] = True
            found[k] |= len(near) > 0
        return pd.DataFrame({"band": band, "bucket": bucket, "node": group["node"][found]})

    def links(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        band, _, i, j = key
        left, right, signs = sides(group, i, j)
        root = pd.factorize(group["root"])[0]
        bags = [bag(h, w) for h, w in zip(group["h"], group["w"])]
        node, out = group["node"].to_numpy(), []
        for k in left:
            near = right[(close_across(signs[k], signs[right], band, threshold) > 0) & (root[right] != root[k])]
            if len(near):
                near = near[similarities(bags[k], [bags[x] for x in near], threshold) >= threshold]
            for other in near:
                if root[other] != root[k]:
                    out.append((node[k], node[other]))
                    root[root == root[other]] = root[k]
        return pd.DataFrame(out, columns=["a", "b"])

    ship_package(members.sparkSession)
    keys = ["band", "bucket", "i", "j"]
    signed = members.join(nodes.select("node", "signature"), "node")
    found = block_pairs(signed).groupBy(*keys).applyInPandas(suspects, "band int, bucket long, node binary")
    found = materialize(found.distinct(), "suspects")
    again = members.join(found, ["band", "bucket", "node"])
    again = again.join(nodes.select("node", "signature"), "node").join(bags_of(found.select("node").distinct(), nodes, rows), "node")
    return materialize(block_pairs(again).groupBy(*keys).applyInPandas(links, "a binary, b binary"), "across")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(node, id, class_id, class_node) of the distinct texts: class_id is the smallest id of a class, class_node its text."""
    rows = id_and_text(docs, id_col, text_col)
    nodes = materialize(nodes_of(rows), "nodes")
    banded = nodes.filter("signature IS NOT NULL").select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "signature")
    start = (F.col("band") * (4 * ROWS) + 1).cast("int")
    banded = banded.select("node", "band", F.xxhash64(F.substring("signature", start, F.lit(4 * ROWS))).alias("bucket"))
    drawn = F.min(F.struct(F.xxhash64("band", "node"), "node"))["node"]
    buckets = banded.groupBy("band", "bucket").agg(drawn.alias("centre"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(banded.join(materialize(buckets, "buckets"), ["band", "bucket"]), "members")
    near = members.filter("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    roots = components(verified(near, nodes, rows, threshold)).withColumnRenamed("id", "node")

    # a bucket of two has been decided; a larger one may hold links that do not touch its centre
    rest = members.filter("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("centre")
    rest = materialize(rest, "rooted")
    split = rest.groupBy("band", "bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("band", "bucket")
    rest = rest.join(materialize(split, "split"), ["band", "bucket"])
    more = across(rest, nodes, rows, threshold)
    rooted = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not more.isEmpty():  # links between roots join their components
        for end in ("a", "b"):
            more = more.join(roots.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        joined = components(more).select(F.col("id").alias("root"), F.col("root").alias("further"))
        rooted = rooted.join(joined, "root", "left").select("node", "id", F.coalesce("further", "root").alias("root"))
    rooted = materialize(rooted, "classes")
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"))
    least = materialize(least.select("root", F.col("first.id").alias("class_id"), F.col("first.node").alias("class_node")), "first")
    return materialize(rooted.join(least, "root").select("node", "id", "class_id", "class_node"), "classes")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per input row: id, ``class_id`` (the smallest id of its near-duplicate class) and ``kept`` (id = class_id).

    A null text is an empty one; texts without words are classes of exact copies. Rows with a null id belong to the class
    of their text, whose ``class_id`` is null only if no row of the class has an id. Other columns are not carried along.
    """
    found = classes(docs, id_col, text_col, threshold).select("node", "class_id")
    rows = id_and_text(docs, id_col, text_col).select("id", node_of(F.col("text")).alias("node"))
    return rows.join(found, "node").select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of each near-duplicate class, with all its columns: that of the smallest id, one of them if it repeats."""
    found = classes(docs, id_col, text_col, threshold)
    first = found.filter("node = class_node").select(F.col("node").alias("__first_node"), F.col("id").alias("__first_id"))
    node = node_of(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    kept = docs.withColumn("__node", node)
    kept = kept.join(first, (kept["__node"] == first["__first_node"]) & kept[f"`{id_col}`"].eqNullSafe(first["__first_id"])).drop("__first_node", "__first_id")
    rows = pick(docs, id=id_col, text=text_col).select("id", node_of(F.coalesce("text", F.lit(""))).alias("node"))
    repeated = rows.groupBy("id", "node").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("node").alias("__node")).distinct()
    repeated = materialize(repeated, "repeated")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "__node", "left_anti").unionByName(kept.join(repeated, "__node", "left_semi").dropDuplicates(["__node"]))
    return kept.drop("__node")
