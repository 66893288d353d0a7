"""Scoring texts with an n-gram model held as a weighted automaton with failure arcs.

The model is hierarchical: P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), where h' is h without its oldest word, down to
word frequencies with half a count added. As an automaton: a state for each context h; an arc for each seen hw, with the
probability above; and a failure arc to h' with the weight m / (c(h) + m), taken where no arc fits. Both give the same
number for every word, so one walk over a text, carrying the state, sums its log-probability.

No table of all n-grams is ever in one place. Documents are dealt into chunks. A chunk lists its distinct n-grams with
their counts, packed by hash range; ranges are summed over all chunks; and each chunk gets back the totals of its own
n-grams, from which it builds the part of the automaton its documents can reach.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .base import id_and_text, materialize
from .quality import fold

#: Bytes of text in a chunk, and of text whose n-grams share a range of hashes. Both bound the memory of a task.
CHUNK_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
REMEMBERED = 300_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class TokenHashes(dict):
    """64-bit hashes of words; bit 0 is set, so that no word has the hash of the end or the start."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return value


END, START = np.uint64(2), np.uint64(4)


@functools.cache
def token_hashes() -> TokenHashes:
    return TokenHashes()


def tokens(text: str) -> np.ndarray:
    """Hashes of the words of a text, split at ASCII white space with A-Z lower-cased, and of the end."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(token_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M1
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


class Chunk:
    """The n-grams of some texts.

    ``index[n - 1][t]`` is the position in ``distinct`` of the n-gram that ends at token t. Start marks stand in front of
    a text. The low three bits of a hash hold the order, and ``distinct`` is ascending.
    """

    def __init__(self, texts: list[str], order: int):
        docs = [tokens(t) for t in texts]
        self.sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        self.place = np.arange(len(flat)) - np.repeat(self.starts, self.sizes)
        gram, grams = spread(flat), []
        for n in range(1, order + 1):
            if n > 1:
                before = np.full(len(flat), START)
                before[n - 1 :] = flat[: max(0, len(flat) - n + 1)]
                before[self.place < n - 1] = START
                gram = spread(gram * M2 + before)
            grams.append(gram & ~np.uint64(7) | np.uint64(n))
        self.distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        self.index = inverse.reshape(order, -1).astype(np.int32)

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """Occurrences of every distinct n-gram in the chosen texts."""
        return np.bincount(self.index[:, chosen[self.doc]].ravel(), minlength=len(self.distinct))


def cuts(distinct: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of hashes begins and ends in ascending hashes."""
    of = ((distinct >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, so that the planes that hardly change compress."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


class Automaton:
    """The states and arcs that the texts of one chunk can reach.

    State 0 is the empty context, the others are contexts seen in training. ``arc_key`` holds ``state * words + word``
    in ascending order; the arcs of state 0 come first, one for each word.
    """

    def __init__(self, chunk: Chunk, totals: np.ndarray, all_tokens: int, vocabulary: int, mass: float):
        order, size = chunk.index.shape
        _, self.word = np.unique(chunk.index[0], return_inverse=True)
        self.words = int(self.word.max(initial=-1)) + 1
        found = totals[chunk.index].astype(float)
        self.known = found[0] > 0
        p = (found[0] + 0.5) / (all_tokens + 0.5 * (vocabulary + 1))
        self.base = np.log10(p)
        first = chunk.place == 0
        ends = chunk.starts + chunk.sizes - 1
        texts = found[0][ends[0]] if size else 0.0  # each training text has one end
        # in front of token t: how often its context of length n was followed by a token, and the state of that context
        state, fail_to, fail_log = [np.zeros(size, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1)]
        arcs = [(np.zeros(size, np.int64), np.ones(size, bool), self.base)]
        count = 1
        for n in range(1, order):
            followed = np.where(first, texts, np.r_[0.0, found[n - 1][:-1]])
            seen = followed > 0
            before = np.r_[np.int64(-1), chunk.index[n - 1][:-1]]
            context = np.where(first, -1, before)[seen]
            _, at, inverse = np.unique(context, return_index=True, return_inverse=True)
            mine = np.zeros(size, np.int64)
            mine[seen] = count + inverse
            count += len(at)
            fail_to.append(state[-1][seen][at])
            fail_log.append(np.log10(mass / (followed[seen][at] + mass)))
            p = np.where(seen, (found[n] + mass * p) / (followed + mass), p)
            arcs.append((mine, seen & (found[n] > 0), np.log10(p)))
            state.append(mine)
        self.fail_to, self.fail_log = np.concatenate(fail_to), np.concatenate(fail_log)
        after = [np.r_[s[1:], np.int64(0)] for s in state]
        self.arc_key, self.arc_log, self.arc_to = [], [], []
        for n, (source, there, log) in enumerate(arcs):
            key, at = np.unique(source[there] * self.words + self.word[there], return_index=True)
            self.arc_key.append(key)
            self.arc_log.append(log[there][at])
            target = np.where(self.known, after[min(n + 1, order - 1)], 0)
            target[ends] = 0
            self.arc_to.append(target[there][at])
        self.arc_key, self.arc_log, self.arc_to = map(np.concatenate, (self.arc_key, self.arc_log, self.arc_to))
        self.start = int(state[-1][0]) if size else 0

    def walk(self, chunk: Chunk) -> np.ndarray:
        """Log-probabilities of all texts, which step through the automaton side by side, longest first."""
        longest_first = np.argsort(-chunk.sizes, kind="stable")
        starts, sizes = chunk.starts[longest_first], chunk.sizes[longest_first]
        state = np.full(len(sizes), self.start)
        total = np.zeros(len(sizes))
        last = len(self.arc_key) - 1
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -t, "left"))  # texts with more than t tokens
            word = self.word[starts[:n] + t]
            at = word.copy()  # the arc of state 0
            going = np.flatnonzero(state[:n])
            while len(going):
                key = state[going] * self.words + word[going]
                arc = np.minimum(np.searchsorted(self.arc_key, key), last)
                fits = self.arc_key[arc] == key
                at[going[fits]] = arc[fits]
                going = going[~fits]
                total[going] += self.fail_log[state[going]]
                state[going] = self.fail_to[state[going]]
                going = going[state[going] > 0]
            total[:n] += self.arc_log[at]
            state[:n] = self.arc_to[at]
        out = np.empty(len(sizes))
        out[longest_first] = total
        return out


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, mass: float = 200.0, folds: int = 5, held_out: int = 1
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Words are what stands between ASCII white space, with A-Z lower-cased; each text has an end after them. All documents
    outside fold ``held_out`` (crc32 of the id as text, modulo ``folds``) are learnt from. ``base_score`` is the sum of
    log10 unigram probabilities with half a count added, ``score`` that of the model of the given ``order``. A null text
    is an empty one and has its end only; a null id stays null and counts as an empty text for the fold. Repeated rows
    are learnt from and scored each. Other columns are not carried along.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be from 1 to 7")
    rows = id_and_text(docs, id_col, text_col).withColumn("learnt", fold(F.col("id"), folds) != held_out)
    size = int(rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
    chunks, ranges = 1 + size // CHUNK_BYTES, 1 + size // RANGE_BYTES
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))

    def count(table: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text").to_pylist(), order)
        counts = chunk.counts(table.column("learnt").to_numpy().astype(bool))
        at = cuts(chunk.distinct, ranges)
        used = np.flatnonzero(np.diff(at))
        return pa.table(
            {
                "range": pa.array(used, pa.int64()),
                "chunk": pa.array([table.column("chunk")[0].as_py()] * len(used), pa.int64()),
                "grams": pa.array([packed(chunk.distinct[at[r] : at[r + 1]]) for r in used], pa.binary()),
                "counts": pa.array([packed(counts[at[r] : at[r + 1]]) for r in used], pa.binary()),
            }
        )

    def add_up(table: pa.Table) -> pa.Table:
        grams = [unpacked(b) for b in table.column("grams").to_pylist()]
        counts = np.concatenate([unpacked(b) for b in table.column("counts").to_pylist()])
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(inverse, counts.astype(float), len(distinct)).astype(np.uint64)
        words = totals[(distinct & np.uint64(7)) == 1]
        parts = np.split(totals[inverse], np.cumsum([len(g) for g in grams])[:-1])
        n = len(parts)
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "range": table.column("range"),
                "totals": pa.array(map(packed, parts), pa.binary()),
                "tokens": pa.array([int(words.sum()), *[0] * (n - 1)], pa.int64()),
                "words": pa.array([int((words > 0).sum()), *[0] * (n - 1)], pa.int64()),
            }
        )

    ship_package(docs.sparkSession)
    listed = rows.groupBy("chunk").applyInArrow(count, "range long, chunk long, grams binary, counts binary")
    summed = listed.groupBy("range").applyInArrow(add_up, "chunk long, range long, totals binary, tokens long, words long")
    summed = materialize(summed, "totals")
    all_tokens, vocabulary = (int(x or 0) for x in summed.agg(F.sum("tokens"), F.sum("words")).first())
    kind = rows.schema["id"].dataType.simpleString()

    def walk(texts: pa.Table, totals: pa.Table) -> pa.Table:
        chunk = Chunk(texts.column("text").to_pylist(), order)
        by_range = sorted(zip(totals.column("range").to_pylist(), totals.column("totals").to_pylist()))
        found = np.concatenate([unpacked(b) for _, b in by_range]) if by_range else np.zeros(0)
        automaton = Automaton(chunk, found, all_tokens, vocabulary, mass)
        if not len(chunk.sizes):
            sums = lambda values: np.zeros(0)
        else:
            sums = lambda values: np.add.reduceat(values, chunk.starts)
        return pa.table(
            {
                "id": texts.column("id"),
                "learnt": texts.column("learnt"),
                "n_tokens": pa.array(chunk.sizes),
                "n_known": pa.array(sums(automaton.known.astype(np.int64)), pa.int64()),
                "base_score": pa.array(sums(automaton.base)),
                "score": pa.array(automaton.walk(chunk)),
            }
        )

    pairs = rows.select("chunk", "id", "text", "learnt").groupBy("chunk").cogroup(summed.select("chunk", "range", "totals").groupBy("chunk"))
    out = pairs.applyInArrow(walk, f"id {kind}, learnt boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("id").alias(id_col), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
