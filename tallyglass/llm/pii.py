"""Personal data: base patterns, and further spans chosen by boosted trees among overlapping candidates.

The base patterns fix what is always found. Generators of high recall propose further spans; boosted trees judge each by
its format and its surroundings; a span is taken where its probability reaches the threshold of its kind, calibrated on
examples kept out of training. Where chosen spans overlap the more probable one stays, and base spans always stay.

There are no labelled spans, so examples are made: in passages around all candidates of all documents, the base spans and
credentials are positive, and written variants of personal data (dotted cards, spelled-out addresses,
unprefixed numbers after a cue, credentials) as well as look-alikes (versions, dates, amounts, order numbers) are planted
with known labels. Other natural candidates are negative only where they have neither a cue nor the format of personal
data; the rest may be real variants and stay unlabelled. Thresholds are calibrated on planted and clearly negative ones.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import random
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, in_workers, materialize, pieces
from .boosting import COUNTED, VALUES, BoostedTrees, fit, fit_table, matrix, numbers, packed, sigmoid, sums_of

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
Span = tuple[str, int, int]

# --- base patterns (fixed by contract) ---
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
GROUP = re.compile(r"[0-9]+")
HEX = frozenset("0123456789abcdefABCDEF")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and dotted domain, walking from @ to @ so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        # a failed attempt is not scanned again: what precedes this @ cannot be followed by a later one
        done = found.end() if found else at + 1
        at = text.find("@", done)


DOUBLED = dict(zip("0123456789", (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(map(DOUBLED.__getitem__, digits[-2::-2]))
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed and then by start."""
    out = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# --- candidates ---
#: Words before the value of a credential, in English, German, French and Spanish as all cues below.
SECRET_WORDS = (
    "api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd|passwort|kennwort|zugangscode|geheimnis|mot[ _]de[ _]passe|mdp|jeton|cl[eé][ _]secr[eè]te"
    "|contrase[ñn]a|clave|ficha"
)
GENERATORS: tuple[tuple[str, str, re.Pattern], ...] = (
    ("email", "@", re.compile(r"(?<![^\s<>(\[\"',;:])[^\s@<>()\[\]\"',;:]{1,64}+@[^\s@<>()\[\]\"',;:]{3,255}+")),
    ("email", "at", re.compile(r"\b[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?:(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]{1,63}+){1,4}")),
    ("ip", ".", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9A-Za-z])")),
    ("ip", ":", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4}:?){1,6}(?![0-9A-Za-z:])")),
    ("card", "0", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{0,2}[0-9]{2,6}){2,4}(?![0-9A-Za-z])")),
    ("phone", "0", re.compile(r"(?<![0-9A-Za-z+.])[+(]{0,2}[0-9]{1,4}(?:[ ()./-]{1,3}[0-9]{2,5}){1,5}(?![0-9A-Za-z])")),
    ("secret", "=", re.compile(rf"(?i)(?<![a-z])(?:{SECRET_WORDS})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?[^\s\"']{{6,}}+")),
    ("secret", "_", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{12,}+")),
)
#: Searched in lower case.
CUES = {
    "email": re.compile(r"mail|courriel|correo|conta[ck]t|kontakt|write|schreib|[ée]cri[rtv]|escrib|reach|erreich|joindre"),
    "ip": re.compile(r"\bip\b|host|addr|adress|direcci[oó]n|server|serveur|servidor|client|rechner|computer|machine|m[aá]quina|ordina|equipo|from"),
    "card": re.compile(r"card|karte|carte|tarjeta|visa|master|amex|credit|kredit|cr[eé]dit|payment|zahlung|paiement|pago"),
    "phone": re.compile(r"phone|tel\b|tel[.:]|telefon|t[eé]l[eé]phon|tel[eé]fono|rufnummer|r[uü]ckruf|call|anruf|ruf\b|appel|llam|mobil|handy|portable|m[oó]vil|fax|cell|celular"),
    "secret": re.compile(r"token|key|secret|passw|pwd|kennwort|geheim|schl[uü]ssel|mot de passe|jeton|cl[eé]|contrase|clave"),
}
#: Characters before a candidate that are searched for cues.
CONTEXT = 30
FEATURES = (
    "kind length digits letters others upper groups dots dashes blanks slashes plus parens at entropy hex luhn small_parts"
    " letter_before letter_after quote_before sign_before cue any_cue is_base spelled longest_group version_cue"
).split()
VERSION = re.compile(
    r"\bversi[oó]n|\bv\s?$|release|section|abschnitt|secci[oó]n|order|bestell|commande|pedido|invoice|rechnung|facture|factura|build|isbn"
    r"|amount|betrag|montant|importe|total|summe"
)


def candidates(text: str, base: Sequence[Span] | None = None) -> list[Span]:
    """Base spans (``base`` where they are known) and everything the generators propose, without repeats."""
    found = dict.fromkeys(base_spans(text) if base is None else base)
    has_digit = bool(DIGIT.search(text))
    lower = text.lower() if "(at)" in text or "[at]" in text or "(AT)" in text else ""
    for kind, needs, pattern in GENERATORS:
        if needs == "at":
            if not lower:
                continue
        elif needs == "0":
            if not has_digit:
                continue
        elif needs not in text and not (needs == "=" and ":" in text):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            while end > start and text[end - 1] in ".,;:!?)":
                end -= 1
            found[(kind, start, end)] = None
    return list(found)


def entropy(s: str) -> float:
    return -sum([n / len(s) * math.log2(n / len(s)) for n in map(s.count, sorted(set(s)))]) if s else 0.0


def value_of(assignment: str) -> str:
    return re.split(r"[=:]", assignment, maxsplit=1)[-1].strip(" \"'")


def features(text: str, span: Span, base: set[Span]) -> list[float]:
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 1]
    lower = before.lower()
    cue = bool(CUES[kind].search(lower))
    groups = GROUP.findall(s)
    digits = "".join(groups)
    letters = sum(map(str.isalpha, s))
    value = value_of(s) if kind == "secret" else s
    return [
        KINDS.index(kind), len(s), len(digits), letters, len(s) - len(digits) - letters, sum(map(str.isupper, s)), len(groups),
        s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count("+"), s.count("(") + s.count(")"), s.count("@"),
        entropy(value), sum(map(HEX.__contains__, value)) / max(1, len(value)),
        len(digits) >= 12 and luhn(digits), bool(groups) and all(map(small, groups)),
        before[-1:].isalpha(), after.isalpha(), before[-1:] in "\"'<" and before != "", before[-1:] in "=:#$€%/" and before != "",
        cue, cue or any(c.search(lower) for c in CUES.values()), span in base,
        "at)" in s.lower() or "at]" in s.lower(), max(map(len, groups), default=0), bool(VERSION.search(lower)),
    ]


@dataclasses.dataclass
class Detector:
    trees: BoostedTrees
    thresholds: dict[str, float]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by kind as listed and then by start."""
        base = base_spans(text)
        known = set(base)
        extra = [c for c in candidates(text, base) if c not in known]
        if not extra:
            return base, base
        p = self.trees.probability(np.array([features(text, c, known) for c in extra], dtype=float))
        # a byte per character tells what is taken, so that the work is linear in the spans
        taken = bytearray(len(text))
        for _, start, end in base:
            taken[start:end] = b"\1" * (end - start)
        chosen = list(base)
        for i in np.lexsort(([c[1] for c in extra], -p)):
            kind, start, end = extra[i]
            if p[i] >= self.thresholds[kind] and taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                chosen.append(extra[i])
        return base, sorted(chosen, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


# --- examples ---
def digits(r: random.Random, n: int) -> str:
    return f"{r.randrange(10**n):0{n}}"


def card_number(r: random.Random, valid: bool) -> str:
    body = r.choice("3456") + digits(r, 14)
    check = next(d for d in range(10) if luhn(f"{body}{d}"))
    return f"{body}{check if valid else (check + r.randrange(1, 10)) % 10}"


#: Words before planted items, in the languages of :data:`CUES`; a valid card or an eight-group address also stands alone.
PLANTED_CUES = {
    "email": ("mail", "contact", "write to", "schreiben Sie an", "Kontakt", "écrivez à", "courriel", "escriba a", "correo", ""),
    "ip": ("host", "server", "ip", "client ip", "server address", "Rechner", "Server", "serveur", "adresse ip", "servidor", "dirección ip", ""),
    "card": ("card", "visa", "credit card no", "Karte", "Kreditkarte", "carte", "carte de crédit", "tarjeta", "tarjeta de crédito", ""),
    "phone": ("phone", "tel.", "call", "mobile", "fax", "Telefon", "Rufnummer", "Handy", "téléphone", "appelez le", "portable", "teléfono", "llame al", "móvil", ""),
    "number": ("order", "invoice", "version", "release", "section", "isbn", "total", "amount", "Bestellung", "Rechnung", "Version", "Betrag", "commande", "facture", "montant", "pedido", "factura", "versión", "importe", "id", ""),
}


def planted(r: random.Random) -> tuple[str, str, str, bool]:
    """(words before, text, kind, whether it is personal)."""
    word = lambda n=6: "".join(r.choices("abcdefghiklmnoprstuvw", k=n))
    d = lambda n: digits(r, n)
    four = lambda valid: [n[i : i + 4] for n in [card_number(r, valid)] for i in range(0, 16, 4)]
    host = lambda: f"{word()}.{r.choice(['com', 'org', 'net', 'de'])}"
    cue = lambda kind: r.choice(PLANTED_CUES[kind])
    secret = lambda: r.choice(("token", "api_key", "secret", "password", "Passwort", "Kennwort", "mot de passe", "contraseña", "clave"))
    phone = lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"9{d(2)} {d(3)} {d(3)}"))
    options = [
        lambda: (cue("email"), f"{word()}{r.choice(['(at)', ' [at] ', ' (at) '])}{word()}{r.choice(['.', ' (dot) ', '[dot]'])}com", "email", True),
        lambda: (cue("email"), f"{word()}ü.{word()}@{host()}", "email", True),
        lambda: ("", f"{word()}@{word(3)}", "email", False),
        lambda: (cue("ip") if r.random() < 0.6 else "", ":".join(f"{r.choice((0, r.randrange(16), r.randrange(65536), r.randrange(65536))):x}" for _ in range(8)), "ip", True),
        lambda: (r.choice(("at", "time", "um", "à", "a las", "")), f"{r.randrange(24):02}:{d(2)}:{d(2)}", "ip", False),
        lambda: (r.choice([c for c in PLANTED_CUES["ip"] if c]), ". ".join(str(r.randrange(256)) for _ in range(4)), "ip", True),
        lambda: (cue("number"), ".".join(str(r.randrange(400)) for _ in range(4)), "ip", False),
        lambda: (cue("card") if r.random() < 0.6 else "", r.choice(("/", ".", "_", " / ", "--")).join(four(True)), "card", True),
        lambda: (r.choice((*PLANTED_CUES["number"], *PLANTED_CUES["card"])), r.choice(("/", ".", "_", "")).join(four(False)), "card", False),
        lambda: (r.choice(("", *PLANTED_CUES["number"])), d(r.randrange(12, 20)), "card", False),
        lambda: (r.choice([c for c in PLANTED_CUES["phone"] if c]), phone(), "phone", True),
        lambda: (r.choice(("on", "", "from", "am", "vom", "le", "el", *PLANTED_CUES["number"])), r.choice((f"20{d(2)}-0{r.randrange(1, 10)}-1{d(1)}", f"{d(2)}.{d(2)}.19{d(2)}", f"{d(3)} {d(3)}", f"{d(4)}/{d(2)}", f"{d(2)}-{d(2)}")), "phone", False),
        lambda: ("", f"{secret()}{r.choice([' = ', '=', ': '])}\"{''.join(r.choices('0123456789abcdef', k=40))}\"", "secret", True),
        lambda: ("", f"{secret()}{r.choice(['=', ': '])}{word(3)}{d(4)}{r.choice('!#')}{word(3).upper()}", "secret", True),
        lambda: ("", f"{secret()}{r.choice(['=', ': ', ' = '])}{word(r.randrange(4, 8)).capitalize()}{d(r.randrange(2, 5))}{r.choice(('', '!', '#'))}{word(r.randrange(1, 4))}", "secret", True),
        lambda: ("", f"{secret()}: {word(r.randrange(6, 10))}", "secret", False),
        lambda: ("", r.choice(("AKIA", "ghp_", "sk-")) + "".join(r.choices("ABCDEFGH23456789abcdefgh", k=24)), "secret", True),
    ]
    return r.choice(options)()


def credential(text: str, span: Span) -> bool:
    """A natural secret: its value is long and mixes in digits."""
    value = value_of(text[span[1] : span[2]])
    return span[0] == "secret" and len(value) >= 8 and bool(DIGIT.search(value))


DATE = re.compile(r"(?:1[0-9]|20)[0-9]{2}([-/. ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/. ])[0-9]{1,2}\2(?:1[0-9]|20)?[0-9]{2}")


def doubtful(text: str, span: Span) -> bool:
    """Whether a natural candidate has a cue or the format of personal data, so that nobody knows its label."""
    kind, start, end = span
    s, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    digits = digits_of(s)
    if kind == "email":
        return "@" not in s or "." in s.rpartition("@")[2]
    if kind == "secret":
        value = value_of(s)
        return len(value) >= 20 or (len(value) >= 6 and not value.islower())
    if kind == "ip" and ":" in s:
        return s.count(":") > 2 or "::" in s or not s.replace(":", "").isdigit()
    if CUES[kind].search(before):
        return True
    if VERSION.search(before) or DATE.fullmatch(s):
        return False
    if kind == "ip":
        return all(map(small, re.findall(r"[0-9]+", s)))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


#: Characters of a passage on each side of a planted item that are searched; blanks and missing digits keep others out of reach.
REACH = CONTEXT + 10


def examples(text: str, seed: str, plants: int = 14, window: int = 200, most: int | None = None) -> Iterator[tuple[list[float], float, bool]]:
    """Labelled candidates of one text: its own, unless doubtful, and planted ones in passages of its words.

    Of a text's own candidates all are used, or the ``most`` first by a hash of the span and the seed, wherever they stand.
    The last part tells which may calibrate: all but natural positives.
    """
    r = random.Random(seed)
    base = base_spans(text)
    known = set(base)
    shown = candidates(text, base)
    if most is not None:
        shown = sorted(shown, key=lambda c: hash_of(f"{seed}:{c}"))[:most]
    for c in shown:
        personal = c in known or credential(text, c)
        if personal or not doubtful(text, c):
            yield features(text, c, known), float(personal), not personal
    for _ in range(plants if text.strip() else 0):
        at = r.randrange(len(text))
        left, right = DIGIT.sub("", text[at : at + window].replace("@", "")), DIGIT.sub("", text[at + window : at + 2 * window])
        cue, item, kind, personal = planted(r)
        passage = (f"{left} {cue} " if cue else f"{left} ")[-REACH:]
        whole = passage + item + r.choice([" ", ". ", ", "]) + right[:REACH]
        start, end = len(passage), len(passage) + len(item)
        base = base_spans(whole)
        known = set(base)
        for c in candidates(whole, base):
            inside = c[1] < end and c[2] > start
            if inside and c not in known:
                exact = abs(c[1] - start) <= 1 and abs(c[2] - end) <= 1 and c[0] == kind
                yield features(whole, c, known), float(personal and exact), True


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None, precision: float = 0.98, seed: int = 0) -> Detector:
    """Fit on every row of ``docs``; thresholds come from the fifth left out. Repeated rows count as often as they occur.

    A kind's threshold is the smallest at which the examples above it are personal to ``precision``; where none is, the
    kind adds no spans. Examples are counted per vector of feature cells in Spark, trees and thresholds come from these
    counts. A ``sample`` is for trials: trees are fitted on the driver, on as many documents, see :func:`train_on_sample`.
    """
    if sample is not None:
        return train_on_sample(docs, id_col, text_col, sample, precision, seed)

    counted = materialize(count_examples(docs, id_col, text_col, seed), "pii-examples")
    trees = fit_table(counted, len(FEATURES))
    if trees is None:
        return Detector(BoostedTrees(-40.0, []), dict.fromkeys(KINDS, 2.0))
    return Detector(trees, thresholds_of(counted, trees, precision))


def count_examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The examples of all rows, counted per vector of feature cells, in the columns of ``COUNTED``; a fifth of the rows is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, held = array("d"), array("d"), array("b")  # no objects, so that nothing waits for the garbage collector

        def counts() -> pa.RecordBatch:
            out = packed(np.array(x).reshape(len(y), -1), np.array(y), np.array(held))
            del x[:], y[:], held[:]
            return out

        for batch in (part for whole in batches for part in pieces(whole)):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                name = f"{seed}:{key}:{hashlib.md5(text.encode()).hexdigest()}"
                out = hash_of(name) % 5 == 0
                for row, personal, judged in examples(text, name):
                    if judged or not out:  # natural positives do not calibrate
                        x.extend(row)
                        y.append(personal)
                        held.append(out)
                    if len(y) == 20_000:
                        yield counts()
        if y:
            yield counts()

    counted = in_workers(id_and_text(docs, id_col, text_col), run, COUNTED).groupBy("cells", "held")
    return counted.agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


#: Thresholds are probabilities of margins that are multiples of 1 / STEPS, up to LIMIT.
STEPS, LIMIT = 256, 40


def thresholds_of(counted: DataFrame, trees: BoostedTrees, precision: float) -> dict[str, float]:
    """The threshold of every kind from all examples held out, counted per kind and step of the margin."""
    slots = STEPS * LIMIT + 1

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits = np.zeros(len(KINDS) * slots), np.zeros(len(KINDS) * slots)
        for batch in batches:
            x = VALUES[matrix(batch, "cells", "<u2")]
            step = np.floor(trees.margin(x) * STEPS)
            slot = (np.rint(x[:, 0]) * slots + np.clip(step, 0, slots - 1)).astype(np.int64)[step >= 0]
            n += np.bincount(slot, numbers(batch, "n")[step >= 0], len(n))
            hits += np.bincount(slot, numbers(batch, "positives")[step >= 0], len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64)), pa.array(hits[at].astype(np.int64))], ["slot", "n", "positives"])

    found = sums_of(counted.filter("held"), margins, "slot", "n", "positives")
    out = dict.fromkeys(KINDS, 2.0)
    total, last = [0, 0], -1
    for slot in sorted(found, key=lambda s: (s // slots, -s)):
        kind, step = divmod(slot, slots)
        total = [a + b for a, b in zip(total, found[slot])] if kind == last else list(found[slot])
        last = kind
        if total[1] >= precision * total[0]:
            out[KINDS[kind]] = float(sigmoid(np.float64(step / STEPS)))
    return out


def train_on_sample(docs: DataFrame, id_col: str, text_col: str, sample: int, precision: float, seed: int) -> Detector:
    """Fit on at most ``sample`` documents, the first by hash of id and text, and at most 40 candidates of each; repeated rows
    count once."""
    rows = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    keys = rows.select("id", "h").groupBy("id", "h").count().orderBy(F.xxhash64("id", "h", F.lit(seed)), "id", "h").limit(sample)
    keys = F.broadcast(keys.select(F.col("id").alias("key"), F.col("h").alias("hash")))  # at most `sample` pairs
    chosen = rows.join(keys, F.col("id").eqNullSafe(F.col("key")) & (F.col("h") == F.col("hash")))
    rows = chosen.groupBy("id", "h").agg(F.min("text").alias("text")).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            made = [(hash_of(f"{seed}:{k}"), *e) for k, t in zip(keys, texts) for e in examples(t, f"{seed}:{k}", most=40)]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([m[0] for m in made], pa.int32()), "x": pa.array([list(map(float, m[1])) for m in made], pa.list_(pa.float64())), "y": pa.array([m[2] for m in made], pa.float64()), "judged": pa.array([m[3] for m in made], pa.bool_())}
            )

    made = in_workers(rows, run, "part int, x array<double>, y double, judged boolean").toPandas()  # a bounded number for each of the documents
    made = made.sort_values(["part", "y"], kind="stable") if len(made) else made
    if not len(made):
        return Detector(BoostedTrees(-40.0, []), dict.fromkeys(KINDS, 2.0))
    x, y, part, judged = np.array(made["x"].tolist()), made["y"].to_numpy(), made["part"].to_numpy(), made["judged"].to_numpy(dtype=bool)
    order = np.lexsort((judged, *x.T, y, part))
    x, y, part, judged = x[order], y[order], part[order], judged[order]
    kept_out = part % 5 == 0
    trees = fit(x[~kept_out], y[~kept_out])
    p = trees.probability(x)
    judged &= kept_out
    thresholds = {k: threshold(p[m], y[m], precision) for i, k in enumerate(KINDS) for m in [judged & (x[:, 0] == i)]}
    return Detector(trees, thresholds)


def hash_of(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:7], 16)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    good = (hits / np.arange(1, len(p) + 1) >= precision) & (np.r_[p[1:], -1] < p) & (p >= 0.5)
    return float(p[np.flatnonzero(good)[-1]]) if good.any() else 2.0


# --- operators ---
def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of base spans, SHA-256 of the joined base spans, all spans joined.

    Spans are ``kind:start:end`` in code points, by kind as listed in ``KINDS`` and then by start. A null text is an empty
    one; null ids stay null, repeated rows give repeated rows, and other columns are not carried along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            found = [detector.spans(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            names = ["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, digest, pa.array([joined(a) for _, a in found], pa.string())], names)

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return in_workers(rows, run, f"id {kind}, {counts}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def masked(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the union is replaced."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, detector: Detector, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all spans masked in ``text_col`` and ``chars_col``, where there is one, brought up to date.

    All columns and rows stay; a null text stays null, and so does its number of characters.
    """
    spark_columns, types = docs.columns, docs.schema
    at = spark_columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, at):
                texts = [None if t is None else masked(t, detector.spans(t)[1]) for t in batch.column(at).to_pylist()]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = in_workers(docs, run, types)
    if chars_col in spark_columns:
        out = out.withColumn(chars_col, F.char_length(F.col(f"`{text_col}`")).cast(types[chars_col].dataType))
    return out
