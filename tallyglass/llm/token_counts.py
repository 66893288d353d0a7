"""Exact token counts of every prefix of a text under a byte-level BPE vocabulary, by dynamic programming over prefixes.

The encoding of a prefix has one last token, and cutting it off leaves the encoding of a shorter prefix. So position i
of a pre-token has one valid last token t: the one whose start has been reached by a token that BPE would not have
merged any part of t into. Its count is the count at its start plus one. The last entry is the count of the whole
piece, the others answer truncation and budget questions, and nothing is encoded twice.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, in_workers, pieces

#: Fixed values of the vocabulary's pre-tokenizer.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers; the memory is emptied when full, which only costs time.
REMEMBERED = 400_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(spare)): b for b in range(256)}


class PrefixCounter:
    """Token counts of all prefixes of a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda piece: bytes(alphabet[c] for c in piece)
        special = {a["content"] for a in spec["added_tokens"]}
        self.ids = {raw(piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (raw(p) for p in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = self.ids[left], self.ids[right]
            self.rank[pair] = rank
            self.halves.setdefault(self.ids[left + right], (rank, *pair))
        self.longest = max(map(len, self.ids))
        self.pre_token = regex.compile(PRE_TOKEN)
        self.pre_tokens = self.pre_token.findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.adjacent: dict[int, bool] = {}
        self.counts = Remembered(self.count_piece)

    def stands(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` as neighbours instead of merging across their border.

        Their edges at the border grow merge by merge. Two edge tokens meet until the first of them is merged inside
        its own side; a merge of both that ranks lower happens before that. Equal ranks: the left one comes first.
        """
        left_end = right_end = NEVER
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < left_end and rank <= right_end:
                return False
            of_a, of_b = self.halves.get(a), self.halves.get(b)
            if of_a is None and of_b is None:
                return True
            # step back in time: undo the later of the two merges
            if of_b is None or (of_a is not None and of_a[0] >= of_b[0]):
                left_end, a = of_a[0], of_a[2]
            else:
                right_end, b = of_b[0], of_b[1]

    def prefix_counts(self, piece: bytes) -> list[int]:
        """``out[i]``: the number of tokens of ``piece[:i]``, for one pre-token."""
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        ids, adjacent, longest = self.ids, self.adjacent, self.longest
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                t = ids.get(piece[j:i])
                if t is None:
                    continue
                if j:
                    key = last[j] << 20 | t
                    ok = adjacent.get(key)
                    if ok is None:
                        if len(adjacent) >= REMEMBERED:
                            adjacent.clear()
                        ok = adjacent[key] = self.stands(last[j], t)
                    if not ok:
                        continue
                last[i], count[i] = t, count[j] + 1
                break
        return count

    def count_piece(self, piece: str) -> int:
        return self.prefix_counts(piece.encode())[-1]

    def count(self, text: str) -> int:
        """Tokens of the whole text; special strings count as one token each."""
        total = 0
        for part, special in self.parts(text):
            total += 1 if special else sum(map(self.counts.__getitem__, self.pre_tokens(part)))
        return total

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.special is None or not (found := [m.span() for m in self.special.finditer(text)]):
            yield text, False
            return
        at = 0
        for start, end in found:
            yield text[at:start], False
            yield text[start:end], True
            at = end
        yield text[at:], False

    def plain(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.pre_tokens(text)))

    def table(self, text: str) -> np.ndarray:
        """``out[p]``: the number of tokens of ``text[:p]``, p in code points."""
        out = np.zeros(len(text) + 1, dtype=np.int32)
        done = at = 0
        tail, tail_count = "", 0
        for part, special in self.parts(text):
            if special:
                # inside a special string the prefix ends in ordinary text that may join the piece before it
                for k in range(1, len(part)):
                    out[at + k] = done - tail_count + self.plain(tail + part[:k])
                at, done = at + len(part), done + 1
                tail, tail_count = "", 0
                out[at] = done
                continue
            space_at, space_done = at, done
            for piece in self.pre_tokens(part):
                before = done
                if piece.isspace():
                    if not tail.isspace():
                        space_at, space_done = at, done
                    for k in range(1, len(piece) + 1):
                        out[at + k] = space_done + self.plain(text[space_at : at + k])
                    done = before + self.counts[piece]
                elif piece[0] == "'" and len(piece) > 1:
                    for k in range(1, len(piece) + 1):
                        out[at + k] = before + self.plain(piece[:k])
                    done = int(out[at + len(piece)])
                else:
                    counts = self.prefix_counts(piece.encode())
                    ends = np.cumsum([len(c.encode()) for c in piece])
                    out[at + 1 : at + len(piece) + 1] = before + np.asarray(counts)[ends]
                    if piece[0] == " " and tail.isspace():
                        # right after the blank the prefix ends in a run of white space that is one piece
                        out[at + 1] = space_done + self.plain(text[space_at : at + 1])
                    done = before + counts[-1]
                at += len(piece)
                tail, tail_count = piece, done - before
        return out

    def longest_within(self, text: str, budget: int, total: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens; ``total``: the tokens of ``text``."""
        if total <= budget:
            return len(text)
        # A prefix that ends in a piece counts more than what stands before the piece, so the answer ends in the last
        # piece with at most the budget before it. Encoding is the same from any earlier start of a piece on; two
        # pieces back reach over the white space before it.
        starts: list[tuple[int, int]] = []
        done = at = 0
        for part, special in self.parts(text):
            for piece in [part] if special else (m.group() for m in self.pre_token.finditer(part)):
                if done > budget:
                    break
                starts.append((at, done))
                done += 1 if special else self.counts[piece]
                at += len(piece)
        start, before = starts[max(0, len(starts) - 3)]
        return start + int(np.flatnonzero(self.table(text[start:at]) + before <= budget)[-1])


class Remembered(dict):
    """Values of a function by argument; emptied when full."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self.fn(key)
        if len(key) <= 64:
            self[key] = value
        return value


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, kept_chars.

    ``kept_chars`` is the length in code points of the longest prefix with at most ``limit`` tokens. A null text counts
    as an empty one: no bytes, no tokens. A null id stays null; repeated rows give repeated rows; other columns are not
    carried along. ``path`` is the vocabulary file, readable in every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for batch in pieces(whole):
                texts = batch.column("text").to_pylist()
                tokens = [c.count(t) for t in texts]
                kept = [c.longest_within(t, limit, n) for t, n in zip(texts, tokens)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                        pa.array(kept, pa.int64()),
                    ],
                    ["id", "n_bytes", "n_tokens", "over_limit", "kept_chars"],
                )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = in_workers(rows, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")
    return out.withColumnRenamed("id", id_col)


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``prefix_tokens``, whose entry p (from 0) counts the tokens of the first p code points.

    Store it once; :func:`tokens_of_prefix` and :func:`longest_prefix` then answer without encoding. Null texts: ``[0]``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for batch in pieces(whole, most=1 << 20):
                tables = [c.table(t) for t in batch.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, tables)], dtype=np.int32)
                values = pa.array(np.concatenate(tables) if tables else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "prefix_tokens"]
                )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return in_workers(rows, run, f"id {kind}, prefix_tokens array<int>").withColumnRenamed("id", id_col)


def tokens_of_prefix(table: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points (of the whole text if it is shorter)."""
    chars = chars if isinstance(chars, Column) else F.lit(chars)
    return F.element_at(table, F.least(chars + 1, F.size(table)).cast("int"))


def longest_prefix(table: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    return F.size(table) - F.array_position(F.reverse(F.transform(table, lambda n: n <= budget)), True)


def split_points(counter_: PrefixCounter, text: str, budget: int) -> Sequence[int]:
    """Ends, in code points, of consecutive chunks of at most ``budget`` tokens each (a chunk holds a code point at least)."""
    ends, at = [], 0
    while at < len(text):
        rest = text[at:]
        at += max(1, counter_.longest_within(rest, budget, counter_.count(rest)))
        ends.append(at)
    return ends
