"""Toxicity by a weighted lexicon, matched in folded text by an automaton."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshare.llm.common import text_or_empty
from wattshare.session import staged

# Letters that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v",
    "τ": "t", "υ": "u", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases in which a lexicon word is no insult; add own ones by the parameter.
EXCEPTIONS = ("trash can", "trash bin", "recycle and trash", "class clown fish", "clown fish", "clownfish", "sore loser rule")

#: Bounds of the fit: labelled rows per label, candidate terms, and characters of a word's beginning that may be a term.
SAMPLE_TOXIC, SAMPLE_CLEAN, MOST_TERMS, PREFIX_CHARS = 6_000, 12_000, 2_048, (3, 4, 5, 6, 7)
#: A term shows in so many toxic documents and has this log-odds at least; every toxic document is to be met so often.
LEAST_DOCS, LEAST_WEIGHT, COVER = 3, 1.0, 4

_SIGNED = re.compile(r"(?<=[^\W\d_])[013457@$]+(?=[^\W\d_])|\b[013457@$]+(?=[^\W\d_]{2})")


def _fold_table() -> dict[int, str]:
    """Lower case, marks dropped, look-alikes replaced, everything but letters and digits a blank (one BMP pass)."""
    out: dict[int, str] = {}
    for code in range(0x3000):
        low = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        base = "".join(HOMOGLYPHS.get(c, c) for c in base)
        if unicodedata.combining(chr(code)) or code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060):
            base = ""
        elif not base or not all(c.isalnum() for c in base):
            base = " "
        if base != chr(code):
            out[code] = base
    for code in range(0xFF01, 0xFF5F):  # full-width forms
        base = chr(code - 0xFEE0).lower()
        out[code] = base if base.isalnum() else " "
    return out


_FOLD: dict[int, str] = {}


def folded(text: str) -> str:
    """Text as blanks and lower-case words; digits between letters read as the letters they stand for."""
    if not _FOLD:
        _FOLD.update(_fold_table())
    if any(c in text for c in "013457@$"):
        text = _SIGNED.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
    return text.translate(_FOLD)


def terms_of(words: set[str], prefixes: Sequence[int] = PREFIX_CHARS) -> set[str]:
    """Lexicon entries that words can show: ``word `` whole, and beginnings without the blank."""
    out = {w + " " for w in words}
    for n in prefixes:
        out.update(w[:n] for w in words if len(w) > n)
    return out


def _document_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document counts of terms within the batch: (term, toxic, clean)."""
    from collections import Counter

    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(batch["_text"].tolist(), batch["_label"].tolist()):
            counts[int(label)].update(terms_of(set(folded(text).split())))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"term": terms, "toxic": [counts[1][t] for t in terms], "clean": [counts[0][t] for t in terms]})


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms, and the logistic curve over weighted hits per word."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    bias: float

    def score(self, rate: float) -> float:
        z = self.slope * rate + self.bias
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _automaton(weights: dict[str, float], exceptions: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in weights.items():
        found.add_word(" " + term, (len(term) + 1, weight))
    for phrase in exceptions:
        text = " " + " ".join(folded(phrase).split()) + " "
        found.add_word(text, (len(text), None))
    found.make_automaton()
    return found


def hit_rate(text: str, found) -> float:
    """Sum of the weights of words hit, the strongest term of each word, over a damped length.

    Hits inside an exception phrase count nothing.  The length counts as its square root, so that a few insults in a
    long text still show while a chance hit there weighs less than in a short one.
    """
    words = folded(text).split()
    if not words or not len(found):
        return 0.0
    line = " " + " ".join(words) + " "
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for last, (length, weight) in found.iter(line):
        start = last - length + 1
        if weight is None:
            spared.append((start, last))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    total = sum(w for s, w in best.items() if not any(a <= s < b for a, b in spared))
    return total / math.sqrt(len(words) + 20)


def _rates(weights: dict[str, float], exceptions: tuple[str, ...], keep: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _automaton(weights, exceptions)
        for batch in batches:
            out = batch[list(keep)].copy()
            out["_rate"] = [hit_rate(t, found) for t in batch["_text"].tolist()]
            yield out
    return run


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    exceptions: Sequence[str] = EXCEPTIONS, most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN,
    most_terms: int = MOST_TERMS,
) -> Lexicon:
    """Learn terms and their weights, then the logistic curve, from a bounded sample of labelled rows.

    Held-out rows are never used.  The sample takes distinct texts by a hash of their id: ``most_toxic`` and
    ``most_clean`` at most.  Only ids, labels and text hashes are shuffled to draw it; the drawn ids, bounded by the two
    limits, are broadcast to read their texts.  A term is a folded word or the beginning of one; its weight is the
    log-odds of toxic against clean documents that show it.  Of at most ``most_terms`` candidates those are kept
    that a greedy cover of the toxic texts needs (``_covering``).  The candidates, their places in sampled texts and one
    number pair per sampled row reach the driver.  Rows with a null label are left out; without both labels the
    lexicon is empty and every score next to 0.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(
        F.col(id_col).cast("string").alias("_key"), F.col(label_col).cast("int").alias("_label")).distinct()
    rows = docs.select(F.col(id_col).cast("string").alias("_key"), text_or_empty(F.col(text_col)).alias("_text"))
    # Copies would make their chance words look like terms: one row of each text, told by its hash.
    hashes = staged(rows.select("_key", F.xxhash64("_text").alias("_hash")).join(known, "_key").groupBy("_hash", "_label").agg(
        F.min("_key").alias("_key")).drop("_hash"), "toxicity-rows")
    order = [F.xxhash64("_key"), "_key"]
    drawn = staged(hashes.filter("_label = 1").orderBy(*order).limit(most_toxic).unionByName(
        hashes.filter("_label = 0").orderBy(*order).limit(most_clean)), "toxicity-drawn")
    sample = staged(rows.join(F.broadcast(drawn), "_key").dropDuplicates(["_key", "_label"]), "toxicity-sample")
    sizes = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    empty = Lexicon({}, tuple(exceptions), 0.0, -50.0)
    if not toxic or not clean:
        return empty
    # A handful of rows of a few KB each per task, so that words of one task combine.
    spread = sample.repartition(max(1, -(-(toxic + clean) // 500)), F.xxhash64("_key"))
    terms = spread.mapInPandas(_document_terms, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(F.col("t") >= LEAST_DOCS)
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    best = terms.withColumn("w", weight).filter(F.col("w") >= LEAST_WEIGHT).orderBy(
        F.desc(F.col("w") * F.sqrt("t")), "term").limit(most_terms).collect()
    shown = spread.filter("_label = 1").mapInPandas(
        _shown({r["term"] for r in best}), "terms array<string>").collect()
    weights = _covering([r["terms"] for r in shown], {r["term"]: float(r["w"]) for r in best},
                        {r["term"]: r["c"] * toxic / clean for r in best}, 0.8 * math.log(clean + 1))
    if not weights:
        return empty
    pairs = sample.mapInPandas(_rates(weights, tuple(exceptions), ("_label",)), "_label int, _rate double").collect()
    slope, bias = _logistic([r["_rate"] for r in pairs], [r["_label"] for r in pairs])
    return Lexicon(weights, tuple(exceptions), slope, bias)


def _shown(candidates: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"terms": [sorted(terms_of(set(folded(t).split())) & candidates) for t in batch["_text"]]})
    return run


def _covering(
    shown: Sequence[Sequence[str]], weights: dict[str, float], cost: dict[str, float], strong: float,
) -> dict[str, float]:
    """Few terms by which every toxic document is met ``COVER`` times, chosen greedily.

    A term gains the documents still to be met (less if its weight is below ``strong``), loses twice the clean ones it
    shows in (scaled to as many), and is taken while it gains ``LEAST_DOCS`` less a half: chance words of few
    documents stay out.
    """
    import heapq

    meets: dict[str, list[int]] = {t: [] for t in weights}
    for i, terms in enumerate(shown):
        for t in terms:
            meets[t].append(i)
    need = [COVER] * len(shown)

    def gain(term: str) -> float:
        return sum(need[i] > 0 for i in meets[term]) * min(1.0, weights[term] / strong) - 2 * cost[term]

    # Gains only fall, so a stale value at the top of the heap is an upper bound.
    heap = [(-gain(t), t) for t in sorted(weights)]
    heapq.heapify(heap)
    chosen: dict[str, float] = {}
    while heap:
        _, term = heapq.heappop(heap)
        now = gain(term)
        if heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, term))
        elif now < LEAST_DOCS - 0.5:
            break
        else:
            chosen[term] = weights[term]
            for i in meets[term]:
                need[i] -= 1
    return chosen


def _logistic(rates: list[float], labels: list[int], steps: int = 60) -> tuple[float, float]:
    """Newton's method with a small ridge, classes weighted alike (rates scaled for the fit)."""
    import numpy as np

    x, y = np.array(rates), np.array(labels, dtype=float)
    scale = x.std() or 1.0
    x = x / scale
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-12
        ridge = 1e-4
        haa, hab, hbb = (h * x * x).sum() + ridge, (h * x).sum(), h.sum() + 1e-9
        ga, gb = (g * x).sum() + ridge * a, g.sum()
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return max(0.0, float(a / scale)), float(b)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, score``; one pass without a shuffle over whole texts.

    Null and empty texts, and texts without letters, score as without hits; ids may be null or repeat.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.select(F.col(id_col).cast("string").alias("_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rates = sent.mapInPandas(_rates(lexicon.weights, lexicon.exceptions, ("_id",)), "_id string, _rate double")
    z = F.col("_rate") * lexicon.slope + lexicon.bias
    return rates.select(F.col("_id").cast(id_type).alias(id_col), (1 / (1 + F.exp(-z))).alias("score"))


def score_column(lexicon: Lexicon, text: Column) -> Column:
    """The score as a column, for filters that keep all other columns."""
    exceptions, weights = lexicon.exceptions, lexicon.weights

    def rates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = _automaton(weights, exceptions)
        for batch in batches:
            yield pd.Series([hit_rate(t or "", found) for t in batch.tolist()], dtype="float64")

    rate = F.pandas_udf(rates, "double", F.PandasUDFType.SCALAR_ITER)(F.coalesce(text.cast("string"), F.lit("")))
    return 1 / (1 + F.exp(-(rate * lexicon.slope + lexicon.bias)))


def held_out(id_column: Column) -> Column:
    """Rows never used for fitting: CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))

