"""Pairs of unit vectors above a cosine, found through bands of sign bits and checked exactly.

The signs of a vector's products with random directions agree between two vectors at an angle t with probability 1 - t/pi
each. A band is a few such bits; vectors that share one of several bands are candidates. Bits grow with the logarithm of
the rows, so that bands hold few unrelated vectors, and there are as many bands as the wanted recall at the threshold takes.

Only band numbers of all rows are shuffled to find the bands that more than one row is in. The vectors follow for those
alone: most rows of a table without near copies never move. A band that many rows share is cut into blocks, and every two
blocks meet in a task of bounded size. A pair is judged in the first band it shares. What leaves a task is either the pairs
above the threshold, or for each row the number of its partners and a spanning forest, at most a link per row.

Bands separate little where most vectors point nearly the same way, as counts of words do. Their rows are counted first, and
where bands would take more work than the exact search of all pairs in large blocks (:mod:`.pairs`), or send rows many times
where the search does not, that is done instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .pairs import partners_and_roots, rows_of_block, similar_representatives, size_of, stored_rows

#: Seconds of work, about, for a row that is sent to a meeting, and for a component of a cosine.
ROW_WORK, COMPONENT_WORK = 2e-5, 5e-10
#: The same where blocks are stored and every two are read.
STORED_ROW_WORK, STORED_COMPONENT_WORK = 2e-6, 4e-11
#: Times each of its bands that a row is sent at most on average, so that what is written follows the rows.
MOST_SENT = 2
#: Unrelated vectors that share a band on average, and rows of a band that go to a task together at most.
TOGETHER, BLOCK_ROWS = 8, 2048
#: Rows a worker gets in one call, about, and the least number of such parts.
PART_ROWS, LEAST_PARTS = 16_384, 8
RECALL = 0.98
MOST_BITS = 40


def band_plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a band, and bands."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be in (0, 1], recall between 0 and 1")
    bits = min(MOST_BITS, max(1, round(math.log2(max(2, rows / TOGETHER)))))
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if shared >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - shared)))


def band_numbers(x: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """The bands of every row, as numbers that differ between bands."""
    found = np.empty((len(x), bands), dtype=np.int64)
    weights = 1 << np.arange(bits, dtype=np.int64)
    for band in range(bands):
        directions = np.random.default_rng([seed, band]).normal(size=(x.shape[1], bits))
        found[:, band] = ((x @ directions > 0) @ weights) | band << MOST_BITS
    return found


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Row and column numbers of links that join what ``hit`` joins, without a cycle; rows and columns are different nodes."""
    labels = np.arange(hit.shape[1])
    joined = []
    for i in np.flatnonzero(hit.any(axis=1)):
        columns = np.flatnonzero(hit[i])
        own, first = np.unique(labels[columns], return_index=True)
        joined += [(int(i), int(columns[k])) for k in first]
        if len(own) > 1:
            labels[np.isin(labels, own)] = own[0]
    return joined


def _coded(folded: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    id_type = folded.schema["rep"].dataType.simpleString()

    def code(batches):
        for pdf in batches:
            if len(pdf):
                numbers = band_numbers(np.vstack(pdf["vec"].to_numpy()), bits, bands, seed)
                yield pd.DataFrame({"rep": pdf["rep"], "bands": list(numbers)})

    return folded.select("rep", "vec").mapInPandas(code, f"rep {id_type}, bands array<bigint>")


def _shared(coded: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """All rows of all bands, and the bands of several rows with their rows and blocks."""
    entries = coded.select("rep", F.explode("bands").alias("band"))
    sizes = entries.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    return entries, sizes.select("band", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), "n")


def all_pairs_are_less(folded: DataFrame, threshold: float, recall: float, block_rows: int, seed: int, stored: bool = False) -> bool:
    """Whether comparing all rows in large blocks is less work than comparing those that share a band.

    ``stored`` says that the blocks are those of :func:`.pairs.partners_and_roots`, which sends no rows. Then bands so crowded
    that their blocks are sent many times give way to it as well: what they write would grow with the square of the rows.
    """
    ship_package(folded.sparkSession)
    total, width = size_of(folded)
    bits, bands = band_plan(total, threshold, recall)
    _, sizes = _shared(_coded(folded, bits, bands, seed), block_rows)
    n = F.col("n").cast("double")
    sent, pairs = sizes.agg(F.coalesce(F.sum(n * F.col("blocks")), F.lit(0.0)), F.coalesce(F.sum(n * n / 2), F.lit(0.0))).first()
    block, row_work, component_work = (stored_rows, STORED_ROW_WORK, STORED_COMPONENT_WORK) if stored else (rows_of_block, ROW_WORK, COMPONENT_WORK)
    whole = total * math.ceil(total / block(total, width)) * row_work + total * total / 2 * width * component_work
    return whole < sent * ROW_WORK + pairs * width * COMPONENT_WORK or (stored and sent > MOST_SENT * bands * total)


def _meetings(folded: DataFrame, threshold: float, recall: float, block_rows: int, seed: int) -> DataFrame:
    """The rows of every two blocks that share a band, with their vectors: part, band, i, j and block.

    A part is what one call of a worker gets: all rows of some meetings, about ``PART_ROWS`` of them.
    """
    bits, bands = band_plan(folded.count(), threshold, recall)
    coded = _coded(folded, bits, bands, seed).checkpoint()
    entries, sizes = _shared(coded, block_rows)
    rows = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    shared = entries.join(sizes.drop("n"), "band")
    vectors = folded.join(coded, "rep").select("rep", "vec", "copies", "bands")
    block = F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int")
    sent = shared.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("rep", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    part = F.pmod(F.xxhash64("band", "i", "j"), F.lit(max(LEAST_PARTS, math.ceil(rows / PART_ROWS)))).alias("part")
    return sent.join(vectors, "rep").select("*", part)


def _judged(pdf: pd.DataFrame, threshold: float):
    """For every two blocks that meet: positions of their rows, of the pairs that count here, and the pairs' cosines."""
    x, codes = np.vstack(pdf["vec"].to_numpy()), np.vstack(pdf["bands"].to_numpy())
    band, i, j, block, rep = (pdf[c].to_numpy() for c in ("band", "i", "j", "block", "rep"))
    order = np.lexsort((rep, j, i, band))
    changes = np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    for own in np.split(order, changes):
        first = own[0]
        if i[first] == j[first]:
            left = right = own
        else:
            left, right = own[block[own] == i[first]], own[block[own] == j[first]]
        if not len(left) or not len(right):
            continue
        cosines = x[left] @ x[right].T
        a, b = np.nonzero(np.triu(cosines >= threshold, 1) if left is right else cosines >= threshold)
        fresh = np.ones(len(a), dtype=bool)
        for earlier in range(band[first] >> MOST_BITS):
            fresh &= codes[left[a], earlier] != codes[right[b], earlier]
        a, b = a[fresh], b[fresh]
        if len(a):
            yield left, right, a, b, cosines[a, b]


def similar_pairs(
    folded: DataFrame, threshold: float, recall: float = RECALL, block_rows: int = BLOCK_ROWS, seed: int = 0, *, exact: bool | None = None
) -> DataFrame:
    """(id_a, id_b, similarity, copies_a, copies_b) of distinct unit vectors (rep, vec, copies), id_a < id_b.

    None below the threshold; a pair at the threshold is missed with probability 1 - ``recall``, closer ones less often.
    ``exact`` says whether all rows are compared instead; by default, if that is less work.
    """
    if all_pairs_are_less(folded, threshold, recall, block_rows, seed) if exact is None else exact:
        return similar_representatives(folded, threshold, pivots=1)
    ship_package(folded.sparkSession)
    id_type = folded.schema["rep"].dataType.simpleString()

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        found = [(left[a], right[b], cosines) for left, right, a, b, cosines in _judged(pdf, threshold)]
        one, two, cosines = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        one, two = np.where(rep[one] < rep[two], one, two), np.where(rep[one] < rep[two], two, one)
        return pd.DataFrame({"id_a": rep[one], "id_b": rep[two], "similarity": cosines, "copies_a": copies[one], "copies_b": copies[two]})

    schema = f"id_a {id_type}, id_b {id_type}, similarity double, copies_a long, copies_b long"
    return _meetings(folded, threshold, recall, block_rows, seed).groupBy("part").applyInPandas(match, schema)


def partners_and_forest(
    folded: DataFrame, threshold: float, recall: float = RECALL, block_rows: int = BLOCK_ROWS, seed: int = 0, *, exact: bool | None = None
) -> DataFrame:
    """(rep, other, links, partners): a line with ``other`` is a link of the spanning forests, one without has a part's counts.

    ``links`` counts the vectors found above the threshold, ``partners`` the rows that carry them. A part hands on at most
    three lines per row it got, however many pairs it has found. ``exact`` is that of :func:`similar_pairs`.
    """
    if all_pairs_are_less(folded, threshold, recall, block_rows, seed, stored=True) if exact is None else exact:
        return partners_and_roots(folded, threshold)
    ship_package(folded.sparkSession)
    id_type = folded.schema["rep"].dataType.simpleString()
    columns = ["rep", "other", "links", "partners"]

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        links, partners = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        ones, twos = [], []
        for left, right, a, b, _ in _judged(pdf, threshold):
            for at, other in ((left[a], right[b]), (right[b], left[a])):
                np.add.at(links, at, 1)
                np.add.at(partners, at, copies[other])
            hit = np.zeros((len(left), len(right)), dtype=bool)
            hit[a, b] = True
            for one, two in forest(hit):
                ones.append(left[one])
                twos.append(right[two])
        some = links > 0
        if not some.any():
            return pd.DataFrame(columns=columns)
        counts = pd.DataFrame({"rep": rep[some], "other": None, "links": links[some], "partners": partners[some]}).astype({"other": object})
        tree = pd.DataFrame({"rep": rep[ones], "other": rep[twos], "links": 0, "partners": 0}).astype({"other": object})
        return pd.concat([counts, tree], ignore_index=True)[columns]

    schema = f"rep {id_type}, other {id_type}, links long, partners long"
    return _meetings(folded, threshold, recall, block_rows, seed).groupBy("part").applyInPandas(match, schema)
