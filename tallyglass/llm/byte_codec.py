"""Byte-level BPE as a streaming transducer with bounded lookahead (after Berglund and van der Merwe, 2023), and back.

How far can text that follows change the tokens of a text? Apply the merges in order of rank to the same text with two
different continuations, and follow the last border both share with all tokens before it alike. At first that is the end
of the text. A merge (x, y) moves it only if x is the token before it and y the token after it in one of the two; it then
lies |x| bytes further left, and the token after it begins with x from then on. So the next merge (z, y') that moves it
has a later rank and a y' that was grown from x to the right. The heaviest such chain of merges, each weighing the bytes
of its left part, is the sufficient lookahead: a token that ends that many bytes before the end of what has been read
stays, whatever follows. The encoder emits such tokens and forgets their bytes, since the tokens behind a border of a
BPE text are the encoding of the text behind it.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, in_workers, pieces

#: The pattern the vocabulary format implies, and the classes its runs may continue with.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUNS = (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*")
#: What the vocabulary file must say for this codec to give the ids of its library.
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}

#: Code points read at a time, and the length from which an unfinished pre-token is fed on in parts.
SLICE, LONG = 1 << 16, 1 << 12
#: Pre-tokens of up to 64 code points a worker remembers; emptied when full, which only costs time.
REMEMBERED = 300_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of the vocabulary file stands for."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token after which no further text can change it (module docstring)."""
    lefts: dict[bytes, set[bytes]] = {}
    heaviest: dict[bytes, int] = {}  # of the chains that end in a merge with this left part

    def begun_by(token: bytes) -> set[bytes]:
        """The tokens that ``token`` may have grown from to the right, itself included."""
        found, todo = set(), [token]
        while todo:
            t = todo.pop()
            if t not in found:
                found.add(t)
                todo.extend(lefts.get(t, ()))
        return found

    for left, right in merges:
        weight = len(left) + max(heaviest.get(t, 0) for t in begun_by(right))
        heaviest[left] = max(heaviest.get(left, 0), weight)
        lefts.setdefault(left + right, set()).add(left)
    return max(heaviest.values(), default=0)


class Known(dict):
    """Bytes of ids; ids outside the vocabulary stand for nothing, as in the library."""

    def __missing__(self, key):
        return b""


class Pieces:
    """The bytes of all ids of a file, which is all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.read(spec)

    def read(self, spec: dict) -> dict[bytes, int]:
        alphabet = byte_alphabet()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ids = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.bytes = Known({i: piece for piece, i in ids.items()} | {i: text.encode() for text, i in self.special.items()})
        return ids


class Vocabulary(Pieces):
    """Tokens, merges and special strings of a file. Raises where the file asks for steps this codec does not take."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        wrong = {k: model.get(k) for k, v in MODEL.items() if (model.get(k) or None) != (v or None)}
        wrong |= {k: splitter.get(k) for k, v in SPLITTER.items() if splitter.get(k) != v}
        wrong |= {f"{a['content']}: {k}": a.get(k) for a in spec["added_tokens"] for k, v in ADDED.items() if a.get(k, v) != v}
        if wrong or spec.get("normalizer"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {wrong or spec['normalizer']}")
        alphabet = byte_alphabet()
        raw = lambda piece: bytes(alphabet[c] for c in piece)
        ids = self.read(spec)
        self.single = [ids.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("the vocabulary lacks single bytes")
        merges = [tuple(raw(p) for p in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        made = {bytes([b]) for b in range(256)}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(merges):
            if left not in made or right not in made:
                raise ValueError("a merge uses a token that no earlier merge makes")
            made.add(left + right)
            self.rank.setdefault((ids[left], ids[right]), rank)
            self.merged.append(ids[left + right])
        self.lookahead = sufficient_lookahead(merges)
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.runs = [regex.compile(r) for r in RUNS]
        longest_first = sorted(self.special, key=len, reverse=True)
        self.find_special = regex.compile("|".join(map(regex.escape, longest_first))).search if longest_first else None
        self.remembered: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of ``data`` as one pre-token: lowest rank first, of equal ranks the leftmost."""
        return self.merge_short(data) if len(data) <= 64 else self.merge_long(data)

    def merge_short(self, data: bytes) -> list[int]:
        single, rank = self.single, self.rank.get
        ids = [single[b] for b in data]
        ranks = [rank(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            ids[i : i + 2] = [self.merged[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list, n log n."""
        n, rank = len(data), self.rank.get
        ids = [self.single[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (s := rank((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def packed(self, piece: str) -> bytes:
        """Ids of a whole pre-token as little-endian 32-bit numbers, through the transducer, remembered."""
        found = self.remembered.get(piece)
        if found is None:
            t = Transducer(self)
            found = np.asarray(t.feed(piece.encode()) + t.finish(), dtype="<i4").tobytes()
            if len(piece) <= 64:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[piece] = found
        return found


class Transducer:
    """Bytes of one pre-token in, stable ids out. Holds less than three lookaheads of bytes between calls."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""
        self.least = 3 * vocabulary.lookahead

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = max(1, self.least)
        for at in range(0, len(data), step):
            self.held += data[at : at + step]
            if len(self.held) >= max(1, self.least):
                out += self.stable()
        return out

    def stable(self) -> list[int]:
        v = self.vocabulary
        ids, at, limit = v.merge(self.held), 0, len(self.held) - v.lookahead
        for k, token in enumerate(ids):
            if at + len(v.bytes[token]) > limit:
                self.held = self.held[at:]
                return ids[:k]
            at += len(v.bytes[token])
        self.held = b""
        return ids

    def finish(self) -> list[int]:
        ids, self.held = self.vocabulary.merge(self.held), b""
        return ids


class Encoder:
    """Text in parts of any size in, packed ids out. Between calls it holds a few bytes, whatever it has read."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.carry = ""  # text whose pre-tokens may still change
        self.tail = ""  # text that may be the beginning of a special string
        self.open: tuple[int, Transducer] | None = None  # a long unfinished pre-token and the kind of its run
        self.fresh = False  # nothing of it has been fed yet

    def feed(self, text: str) -> Iterator[bytes]:
        v = self.vocabulary
        if v.find_special is None:
            yield from self.plain(text, False)
            return
        text, self.tail = self.tail + text, ""
        at = 0
        while (m := v.find_special(text, at)) is not None:
            yield from self.plain(text[at : m.start()], True)
            yield np.asarray([v.special[m.group()]], dtype="<i4").tobytes()
            at = m.end()
        end = len(text)
        for n in range(min(end - at, max(map(len, v.special)) - 1), 0, -1):
            if any(s.startswith(text[end - n :]) for s in v.special):
                end -= n
                break
        self.tail = text[end:]
        yield from self.plain(text[at:end], False)

    def finish(self) -> Iterator[bytes]:
        tail, self.tail = self.tail, ""
        yield from self.plain(tail, True)

    def plain(self, text: str, last: bool) -> Iterator[bytes]:
        """Ids of ordinary text; ``last``: the text ends here."""
        v = self.vocabulary
        if self.open is not None:
            text, done = yield from self.go_on(text, last)
            if not done:
                return
        text, self.carry = self.carry + text, ""
        found = v.pre_tokens(text)
        if not last:
            # the last pre-token may go on, and an apostrophe before it may become a contraction with it
            held, found = found[-2:], found[:-2]
            if held and len(held[-1]) >= LONG:
                found += held[:-1]
                self.begin(held[-1])
            else:
                self.carry = "".join(held)
        packed = v.packed
        yield b"".join([packed(piece) for piece in found])
        if self.open is not None:
            self.carry, text = "", self.carry
            yield from self.go_on(text, False)

    def begin(self, piece: str) -> None:
        """Open a long pre-token; its text waits in ``carry``."""
        kind = next(k for k, run in enumerate(self.vocabulary.runs) if run.fullmatch(piece, 1 if k < 3 and piece[0] == " " else 0))
        self.open, self.carry, self.fresh = (kind, Transducer(self.vocabulary)), piece, True

    def go_on(self, text: str, last: bool):
        """Feed the open pre-token. Gives the text behind it, and whether it has ended."""
        kind, transducer = self.open
        text, self.carry = self.carry + text, ""
        blank = 1 if self.fresh and kind < 3 and text[0] == " " else 0
        self.fresh = False
        end = self.vocabulary.runs[kind].match(text, blank).end()
        ended = last or end < len(text)
        keep = 0
        if kind == 3 and (end < len(text) or not last):
            keep = 1  # the last blank goes with what follows it
        inside, rest = text[: max(0, end - keep)], text[max(0, end - keep) :]
        yield np.asarray(transducer.feed(inside.encode()), dtype="<i4").tobytes()
        if not ended:
            self.carry = rest
            return "", False
        yield np.asarray(transducer.finish(), dtype="<i4").tobytes()
        self.open = None
        return rest, True

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, read in slices."""
        parts: list[bytes] = []
        for at in range(0, len(text), SLICE):
            parts.extend(self.feed(text[at : at + SLICE]))
        parts.extend(self.finish())
        return np.frombuffer(b"".join(parts), dtype="<i4")


class Decoder:
    """Ids in parts of any size in, text out; holds at most three bytes of an unfinished character.

    Bytes that are no UTF-8 become U+FFFD, one for each longest beginning of a character, as in the library.
    """

    def __init__(self, known: Pieces):
        self.bytes = known.bytes
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.text.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.text.decode(b"", True)

    def decode(self, ids: np.ndarray) -> str:
        parts = [self.feed(ids[at : at + SLICE].tolist()) for at in range(0, len(ids), SLICE)]
        return "".join(parts) + self.finish()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def known_pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int), with special strings inside texts as their own ids.

    A null text counts as an empty one and has no ids. A null id stays null, repeated rows give repeated rows, an empty
    table gives an empty one, and other columns of the input, of whatever name, are not carried along. Texts are read in
    slices, so a text needs memory for itself and its ids only. ``path`` is the vocabulary file, readable in every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for batch in pieces(whole):
                rows = [Encoder(v).encode(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists(rows)], ["id", "ids"])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return in_workers(rows, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, ids, text. Null ids give a null text; null and unknown entries are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_pieces(path)
        for batch in batches:
            column = batch.column("ids")
            texts = [Decoder(known).decode(np.asarray(x.values)) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(texts, pa.string())], ["id", "ids", "text"])

    ids = F.filter(F.col(f"`{ids_col}`").cast("array<int>"), lambda i: i.isNotNull())
    picked = rows.select(F.col(f"`{id_col}`").alias("id"), ids.alias("ids"))
    kind = picked.schema["id"].dataType.simpleString()
    return in_workers(picked, run, f"id {kind}, ids array<int>, text string").withColumnsRenamed({"id": id_col, "ids": ids_col})


def lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and per input row: id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256."""
    rows = decode(encode(docs, path, id_col, text_col), path, id_col)
    return rows.select(
        F.col(f"`{id_col}`"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
