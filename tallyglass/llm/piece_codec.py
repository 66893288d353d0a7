"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The lattice has a node per character position; a piece leads from its start to its end. A unigram vocabulary takes the
path of the largest sum of scores. A BPE vocabulary allows two pieces in a row only if merging by score would leave them
as neighbours, which makes the path unique, so the same search gives the ids of BPE. Only as many past positions as the
longest piece has characters can start a further piece. The ids before a boundary are final once the backpointer paths
of all those positions run through it; they are then given out and forgotten.
"""

from __future__ import annotations

import array
import functools
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .base import id_and_text, in_workers, pick, pieces

SPACE = "▁"
#: Words and neighbours a worker remembers; a full memory is emptied, which only costs time.
REMEMBERED = 300_000
#: Fixed value of unigram models: an unknown character costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2


class PieceCodec:
    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE vocabularies are supported")
        self.bpe = model.trainer_spec.model_type == BPE
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.unknown_text = model.trainer_spec.unk_surface
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.surface = [
            self.byte_of[i] if i in self.byte_of
            else b"" if p.type == kinds.CONTROL
            else self.unknown_text.encode() if p.type == kinds.UNKNOWN
            else p.piece.replace(SPACE, " ").encode()
            for i, p in enumerate(model.pieces)
        ]
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.scores.values()) - UNKNOWN_PENALTY
        # where no piece holds a blank after another character, paths always meet before a blank
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if cut else lambda text: [text] if text else []
        self.kinds = {p[n:]: False for p in self.ids for n in range(1, len(p))} | dict.fromkeys(self.ids, True)
        self.follows = _Follows(self)
        self.known = _Words(self)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the pair with the best score, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[p], i) for i, p in enumerate(map("".join, zip(parts, parts[1:]))) if p in self.scores]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def step(self, score: float, last: str | None, piece: str) -> float | None:
        """Score of a path that goes on with ``piece``; None where that cannot be."""
        if not self.bpe:
            return score + self.scores.get(piece, self.unknown_score)
        return score if self.follows[last][piece] else None

    def stream(self, chunks: Iterable[str]) -> Iterator[str]:
        """Pieces of a normalised text that comes in chunks."""
        text, scores, last, start = "", [0.0], [None], [0]
        look = 2 * self.longest
        known, longest, step = self.ids, self.longest, self.step
        for chunk in chunks:
            text += chunk
            while len(scores) <= len(text):
                end, best = len(scores), None
                for at in range(max(0, end - longest), end):
                    piece = text[at:end]
                    if piece in known or at == end - 1:
                        score = step(scores[at], last[at], piece)
                        if score is not None and (best is None or score > best[0]):
                            best = score, piece, at
                            if self.bpe:
                                break
                if best is None:
                    raise ValueError(f"no path reaches the end of {text[max(0, end - longest) : end]!r}")
                scores.append(best[0]), last.append(best[1]), start.append(best[2])
                if end >= look:
                    met = self.meeting(start, end)
                    yield from self.path(last, start, met)
                    text, scores, last = text[met:], scores[met:], last[met:]
                    start = [max(0, s - met) for s in start[met:]]
                    look = 2 * (len(scores) - 1 if not met else self.longest) + len(scores) - 1
        yield from self.path(last, start, len(scores) - 1)

    def short_word(self, word: str) -> list[str]:
        """:meth:`stream` for a BPE word too short for anything to be given out before its end."""
        kinds, follows = self.kinds, self.follows
        last: list[str | None] = [None] * (len(word) + 1)
        start = [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for at in range(end - 1, -1, -1):
                piece = word[at:end]
                whole = kinds.get(piece)
                if (whole or at == end - 1) and follows[last[at]][piece]:
                    last[end], start[end] = piece, at
                    break
                if whole is None and at < end - 1:  # no piece ends so
                    break
        return self.path(last, start, len(word))

    def meeting(self, start: list[int], end: int) -> int:
        """The last boundary on the paths of all positions at which a further piece can start."""
        live = set(range(max(0, end + 1 - self.longest), end + 1))
        while len(live) > 1:
            latest = max(live)
            live.remove(latest)
            live.add(start[latest])
        return live.pop()

    @staticmethod
    def path(last: list, start: list[int], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end = start[end]
        return out[::-1]

    def ids_of(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str) -> np.ndarray:
        words = self.words(self.library.normalize(text))
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.int32)
        if not self.bytes:  # unknown characters in a row are one unknown piece
            ids = ids[~((ids == self.unknown) & (np.r_[-1, ids[:-1]] == self.unknown))]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        out = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = out.decode()
        except UnicodeDecodeError:  # bytes that form no character: each stands for one replacement character
            text = ""
            for is_byte, run in itertools.groupby(ids, self.byte_of.__contains__):
                part = b"".join(map(self.surface.__getitem__, run))
                text += characters(part) if is_byte else part.decode()
        first = next((i for i in ids if self.surface[i]), None)
        if self.dummy_prefix and first is not None and first not in self.byte_of and self.surface[first][:1] == b" " and first != self.unknown:
            text = text[1:]
        return text


def characters(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Follows(dict):
    """By piece (None: the start of a text): whether BPE leaves a piece behind it unmerged, by that piece."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec, self.size = codec, 0

    def __missing__(self, last: str | None) -> _Follow:
        if self.size >= REMEMBERED:
            self.clear()
            self.size = 0
        row = self[last] = _Follow(self, last)
        return row


class _Follow(dict):
    def __init__(self, all_: _Follows, last: str | None):
        super().__init__()
        self.all, self.last = all_, last

    def __missing__(self, piece: str) -> bool:
        alone = [piece] if self.last is None else [self.last, piece]
        ok = self[piece] = self.all.codec.merged("".join(alone)) == alone
        self.all.size += 1
        return ok


class _Words(dict):
    """Ids by word, as the bytes of 32-bit integers: those of late, and those of the generation before, from which a word in use is taken over."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> bytes:
        codec = self.codec
        ids = self.old.get(word)
        if ids is None:
            found = codec.short_word(word) if codec.bpe and len(word) < 2 * codec.longest else codec.stream([word])
            ids = array.array("i", itertools.chain.from_iterable(map(codec.ids_of, found))).tobytes()
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: id, ``ids`` (array of int), ``n_tokens``, and if asked for ``decoded``, the text of the ids.

    A null text is an empty one and has no ids. Repeated rows give repeated rows, null ids stay null, other columns are
    not carried along. ``path`` is the vocabulary file, readable in every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in (part for whole in batches for part in pieces(whole)):
            ids = [c.encode(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in ids], dtype=np.int32)
            values = np.concatenate(ids)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))
            columns = {"id": batch.column("id"), "ids": lists, "n_tokens": pa.array(sizes)}
            if decoded:
                columns["decoded"] = pa.array([c.decode(x.tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, n_tokens int" + ", decoded string" * decoded
    return in_workers(rows, run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and ``text``. Null ids arrays decode to null, empty ones to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [None if x is None else c.decode(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = pick(encoded, id=id_col, ids=ids_col).withColumn("ids", F.col("ids").cast("array<int>"))
    kind = rows.schema["id"].dataType.simpleString()
    return in_workers(rows, run, f"id {kind}, text string").withColumnRenamed("id", id_col)
