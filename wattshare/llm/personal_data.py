"""Personal data by a semi-Markov conditional random field over whole segments.

A text is scored only near anchors (digits and at-signs).  There, tokens are cut into segments: a segment of several
tokens is one entity of one kind, everything else is outside.  Features look at a whole candidate (its shape, digit
count, checksums, what stands beside it), so boundaries and kinds are chosen together by one dynamic programme whose
segments are bounded in tokens.  The weights are trained here, by an averaged structured perceptron, on a bounded sample
of texts whose spans of fixed form serve as labels, and on variants of them that the fixed forms do not cover.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds in the order in which they are listed, and the forms of their spans.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BEFORE = re.compile(r"[A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Longest segment in tokens, and characters around an anchor that belong to its region.
MOST_TOKENS, REACH = 16, 28
#: Bound of the sample of regions that the weights are fitted on, and passes over it.
SAMPLE_DOCS, SAMPLE_REGIONS, PASSES = 400, 600, 4

_JOINING = "-./@:_%+"
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.DOTALL)
_ANCHOR = re.compile(r"[0-9@]")
_CUES = {
    "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card",
    "mastercard": "card", "ssn": "ssn", "social": "ssn", "iban": "iban", "account": "iban", "mail": "email",
    "email": "email", "ip": "ip", "address": "ip", "host": "ip",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban(text: str) -> bool:
    if not 15 <= len(text) <= 34 or not text.isascii() or not text.isalnum() or not text[:2].isalpha():
        return False
    moved = (text[4:] + text[:4]).upper()
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, end, kind) of the fixed forms: leftmost and non-overlapping per kind, in linear time.

    Each kind steps from character to character that its matches cannot do without (an at-sign, a run of digits and dots,
    a plus) and finds there what a scan of the whole text by its pattern finds.
    """
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_BEFORE.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), 0))
        # What precedes a failed sign ends there: no later local part can cross it.
        done = found.end() if found else at + 1
        at = text.find("@", done)
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        place = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            length = sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append((place, place + length, 1))
            place += length + 1
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around anchors, merged where they touch; a number never leaves its region, as each of its digits is an anchor."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shape(text: str) -> str:
    """Runs of letters, digits and blanks as one sign each, with counts of digits up to four."""
    out = []
    for t in _TOKEN.findall(text):
        if t[0].isdigit():
            out.append(f"9{min(len(t), 5)}")
        elif t.isascii() and t.isalpha():
            out.append("a")
        else:
            out.append(" " if t.isspace() else t[0])
    return "".join(out)


def _features(text: str, a: int, b: int, cue: str) -> list[str]:
    """Features of the whole segment ``text[a:b]``."""
    span = text[a:b]
    digits = _NOT_DIGIT.sub("", span)
    letters = sum(c.isalpha() for c in span)
    n = len(digits)
    before, after = text[a - 1:a], text[b:b + 1]
    out = [
        f"shape={_shape(span)}", f"digits={min(n, 20)}", f"letters={min(letters, 8)}", f"cue={cue}",
        f"left={'w' if before.isalnum() else before if before in '+-(.@#/' else ' '}",
        f"right={'w' if after.isalnum() else '-' if after in '-/@' and after else ' '}", "bias",
    ]
    out.append(f"signs={''.join(sorted({c for c in span if not c.isalnum() and not c.isspace()}))[:6]}")
    if span.count("(") != span.count(")"):
        out.append("unbalanced")
    if letters == 0 and 13 <= n <= 19:
        out.append("luhn" if luhn(digits) else "noluhn")
    if "@" in span:
        out.append("at")
        out.append("domain" if _DOMAIN.fullmatch(span[span.rfind("@") + 1:].strip()) else "nodomain")
    if letters == 0 and n and span.count(".") == 3:
        out.append("octets" if all(p.isdigit() and _small(p) for p in span.split(".")) else "nooctets")
    if letters >= 2 and n >= 10:
        out.append("iban" if _iban(span.replace(" ", "")) else "noiban")
    return out


def _closed(text: str, a: int, b: int) -> bool:
    """Whether no letter or digit adjoins the segment, directly or across one joining sign."""
    if a and (text[a - 1].isalnum() or text[a - 1] in _JOINING and a > 1 and text[a - 2].isalnum()):
        return False
    return b == len(text) or not (
        text[b].isalnum() or text[b] in _JOINING and b + 1 < len(text) and text[b + 1].isalnum())


class SegmentModel:
    """Weights by feature, one number per kind; ``decode`` finds the best segmentation of a region."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}

    def score(self, features: Sequence[str]) -> list[float]:
        total = [0.0] * len(KINDS)
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                for k, x in enumerate(w):
                    total[k] += x
        return total

    def candidates(self, text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
        """Token borders of a region, and segments (first token, last + 1, features) that may be entities.

        A segment holds an anchor, neither begins nor ends with white space or closing signs, is no part of a longer
        word or number, crosses no line and has at most ``MOST_TOKENS`` tokens.
        """
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
        kinds = ["9" if text[s].isdigit() else "@" if text[s] == "@" else " " if text[s].isspace()
                 else "a" if text[s].isalpha() else text[s] for s, _ in tokens]
        anchored = [k in "9@" for k in kinds]
        out, cue = [], "-"
        for i, (start, _) in enumerate(tokens):
            if kinds[i] == "a":
                cue = _CUES.get(text[start:tokens[i][1]].lower(), cue if i and kinds[i - 1] in " :" and cue != "-" else "-")
            if kinds[i] not in "9a+([":
                continue
            has = False
            for j in range(i, min(len(tokens), i + MOST_TOKENS)):
                if kinds[j] == " " and ("\n" in text[tokens[j][0]:tokens[j][1]] or tokens[j][1] - tokens[j][0] > 1):
                    break
                has = has or anchored[j]
                if has and kinds[j] in "9a)]" and tokens[j][1] - start >= 7 and _closed(text, start, tokens[j][1]):
                    out.append((i, j + 1, _features(text, start, tokens[j][1], cue)))
        return [s for s, _ in tokens] + [tokens[-1][1] if tokens else b], out

    def decode(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """Best-scoring non-overlapping segments; outside scores 0."""
        borders, found = self.candidates(text, a, b)
        ends: dict[int, list[tuple[int, float, int]]] = {}
        for i, j, features in found:
            scores = self.score(features)
            k = max(range(len(KINDS)), key=scores.__getitem__)
            if scores[k] > 0:
                ends.setdefault(j, []).append((i, scores[k], k))
        best, back = [0.0] * len(borders), [None] * len(borders)
        for j in range(1, len(borders)):
            best[j] = best[j - 1]
            for i, gain, k in ends.get(j, ()):
                if best[i] + gain > best[j]:
                    best[j], back[j] = best[i] + gain, (i, k)
        spans, j = [], len(borders) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                spans.append((borders[i], borders[j], k))
                j = i
        return spans[::-1]


def _examples(texts: Sequence[str]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Regions with gold segments: found ones, and variants drawn by rule in their place or between plain words."""
    rng = random.Random(20)
    plain = [
        "the", "and", "of", "to", "for", "with", "from", "die", "und", "que", "les", "por", "item", "page", "room",
        "version", "chapter", "order", "year", "about",
    ]
    out: list[tuple[str, list[tuple[int, int, int]]]] = []
    for text in texts:
        spans = base_spans(text)
        for a, b in regions(text):
            inside = [s for s in spans if a <= s[0] and s[1] <= b]
            crossing = any(x < y for (_, x, _), (y, _, _) in zip(inside[1:], inside))
            if not crossing and len(out) < SAMPLE_REGIONS:
                out.append((text[a:b], [(s - a, e - a, k) for s, e, k in inside]))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(3, 8)))

    def card() -> str:
        body = digits(15)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def iban() -> str:
        body = rng.choice(["DE", "FR", "ES", "NL"]), digits(18)
        return next(x for c in range(2, 99) if _iban(x := f"{body[0]}{c:02d}{body[1]}"))

    makers = {
        "email": [lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com", lambda: f"{word()} @ {word()}.com",
                  lambda: f"{word()}(@){word()}.org"],
        "ip": [lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))],
        "card": [card, lambda: " ".join(re.findall("....", card())), lambda: ".".join(re.findall("....", card()))],
        "phone": [lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"({digits(3)}) 555-{digits(4)}",
                  lambda: f"{digits(3)}-555-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(7)}"],
        "ssn": [lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"],
        "iban": [iban, lambda: " ".join(re.findall("..?.?.?", iban()))],
        None: [lambda: digits(4), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
               lambda: f'"{rng.getrandbits(160):040x}"', lambda: digits(rng.choice([5, 8, 12, 16, 20])),
               lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}",
               lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"{word()}{digits(3)}", lambda: f"@{word()}{digits(2)}"],
    }
    for kind, forms in makers.items():
        for form in forms:
            for _ in range(30):
                left = " ".join(rng.choice([rng.choice(plain), word()]) for _ in range(3))
                right = " ".join(rng.choice([rng.choice(plain), word()]) for _ in range(3))
                span, stop = form(), rng.choice(["", "", ".", ","])
                text = f"{left} {span}{stop} {right}"
                gold = [] if kind is None else [(len(left) + 1, len(left) + 1 + len(span), KINDS.index(kind))]
                out.append((text, gold))
    rng.shuffle(out)
    return out


def fit_segments(texts: Sequence[str], passes: int = PASSES) -> SegmentModel:
    """Averaged structured perceptron: where the best segmentation errs, gold segments gain and chosen ones lose."""
    model, sums, step = SegmentModel(), {}, 1
    examples = _examples(texts)
    for _ in range(passes):
        for text, gold in examples:
            guess = model.decode(text, 0, len(text))
            if guess != gold:
                borders, found = model.candidates(text, 0, len(text))
                by_span = {(borders[i], borders[j]): f for i, j, f in found}
                for spans, sign in ((gold, 1.0), (guess, -1.0)):
                    for s, e, k in spans:
                        for f in by_span.get((s, e), ()):
                            w = model.weights.setdefault(f, [0.0] * len(KINDS))
                            u = sums.setdefault(f, [0.0] * len(KINDS))
                            w[k] += sign
                            u[k] += sign * step
            step += 1
    for f, w in model.weights.items():
        model.weights[f] = [x - y / step for x, y in zip(w, sums[f])]
    return model


def scan_text(text: str, model: SegmentModel) -> list[tuple[int, int, int]]:
    """Base spans, and those of the model that touch none of them, by start, then kind."""
    areas = regions(text)
    if not areas:
        return []
    base = base_spans(text)
    out, at = list(base), 0
    by_start = sorted((s, e) for s, e, _ in base)
    reach = 0
    for a, b in areas:
        for s, e, k in model.decode(text, a, b):
            # Base spans are sorted by start; keep the farthest end of those that begin before this one.
            while at < len(by_start) and by_start[at][0] < e:
                reach = max(reach, by_start[at][1])
                at += 1
            if reach <= s:
                out.append((s, e, k))
    return sorted(out, key=lambda s: (s[0], s[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _scan(weights: dict[str, list[float]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = SegmentModel(weights)
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan_text(t, model)]
                     for t in batch["_text"].tolist()]
            base = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in base_spans(t)] for t in batch["_text"].tolist()]
            yield pd.DataFrame({"_id": batch["_id"], "spans": spans, "base": base})
    return run


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> SegmentModel:
    """Fit on ``sample_docs`` texts with digits, drawn by a hash of their id; a text over 50,000 characters is not drawn."""
    drawn = docs.filter(F.col(text_col).rlike("[0-9]") & (F.length(text_col) <= 50_000)).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), F.col(text_col).alias("_text"))
    chosen = drawn.orderBy(F.xxhash64("_key"), "_key", F.xxhash64("_text")).limit(sample_docs)
    return fit_segments([r["_text"] for r in chosen.collect()])


def personal_data(
    docs: DataFrame, model: SegmentModel, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, spans, base`` of (kind, start, end) by start, then kind; one pass, no shuffle.

    ``base`` holds the spans of fixed form alone; ``spans`` those and the model's, which may be of the same kinds.
    Null and empty texts have no spans; whole texts are read, in time linear in their length; ids may be null or repeat.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.select(F.col(id_col).cast("string").alias("_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = sent.mapInPandas(_scan(model.weights), f"_id string, spans {SPANS}, base {SPANS}")
    return out.select(F.col("_id").cast(id_type).alias(id_col), "spans", "base")
