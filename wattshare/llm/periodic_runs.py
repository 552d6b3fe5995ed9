"""Periodic runs of words: a Re-Pair grammar per document, runs met once at the boundary of each nonterminal.

The grammar.  Word ids are replaced pair by pair: in each round the pairs of a document that occur at least twice are
taken by their counts, the most frequent first, and every occurrence that no better pair has used up becomes a
nonterminal.  What is left when no pair repeats is paired off neighbour by neighbour.  The rounds work on the arrays of many
documents at once; ids are distinct between documents, so that no pair is shared.

The runs.  A run lies inside the expansion of one lowest nonterminal and crosses the boundary between its two children,
so all runs are found by looking for those that cross a boundary, inside the nonterminal's expansion.  On one side of the
boundary such a run has at least two of its four or more periods, so for periods over 1 the three words around the
boundary recur one period away on that side: only the distances to their other occurrences are tried.  What is
found is translated to every place where the nonterminal was derived; pieces of a longer run that a higher
nonterminal shows whole lie inside it and are merged with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words and this many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words of documents whose grammars are made together (a longer document goes by itself); distances tried at once;
#: word forms a worker remembers before it starts anew.
BATCH_WORDS, TRIED, MEMORY_WORDS = 200_000, 2_000_000, 300_000

RUNS = "array<struct<start:long,length:long,period:long>>"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


# The grammar


def _chosen(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Indices of pairs taken greedily by rank, none overlapping another; equal neighbours (aaa) alternate."""
    new = np.r_[True, (places[1:] != places[:-1] + 1) | (rank[1:] != rank[:-1])]
    inside = np.arange(len(places)) - np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    rank = rank * 2 + (inside % 2 == 0)
    left, taken = np.arange(len(places)), []
    while len(left):
        at, r = places[left], rank[left]
        touch = at[1:] == at[:-1] + 1
        up = r[1:] > r[:-1]
        best = np.ones(len(left), bool)
        best[1:] &= ~touch | up
        best[:-1] &= ~touch | ~up
        taken.append(left[best])
        gone = best.copy()
        gone[1:] |= touch & best[:-1]
        gone[:-1] |= touch & best[1:]
        left = left[~gone]
    return np.sort(np.concatenate(taken)) if taken else left


def grammar(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonterminals and their derivations: ``first`` (start, boundary, end in the text, one row per nonterminal),
    ``rule`` and ``start`` (one entry per derivation).  Symbols are dense numbers from 0, different between documents."""
    total = int(symbols.max()) + 1 if len(symbols) else 0
    size, start, end = len(symbols), np.arange(len(symbols)), np.arange(1, len(symbols) + 1)
    known_pairs, known_rules = np.empty(0, np.int64), np.empty(0, np.int64)
    bounds, rules, starts = [], [], []
    made = 0
    while len(symbols) > 1:
        counts = np.bincount(symbols, minlength=total + made)[symbols] > 1
        places = np.flatnonzero((doc[1:] == doc[:-1]) & counts[1:] & counts[:-1])
        pair = symbols[places] << 32 | symbols[places + 1]
        _, which, often = np.unique(pair, return_inverse=True, return_counts=True)
        several = often[which] > 1
        places, which, pair = places[several], which[several], pair[several]
        if not len(places):
            break
        took = _chosen(places, often[which] * len(often) + which)
        twice = np.bincount(which[took], minlength=len(often))[which[took]] > 1
        took = took[twice]
        if not len(took):
            break
        places, pair = places[took], pair[took]
        unique, first, which = np.unique(pair, return_index=True, return_inverse=True)
        # A pair that an earlier round has named keeps its nonterminal.
        at = np.searchsorted(known_pairs, unique)
        old = np.zeros(len(unique), bool)
        inside = at < len(known_pairs)
        old[inside] = known_pairs[at[inside]] == unique[inside]
        names = np.empty(len(unique), np.int64)
        names[old] = known_rules[at[old]]
        names[~old] = made + np.arange(int((~old).sum()))
        fresh = places[first[~old]]
        bounds.append(np.stack([start[fresh], start[fresh + 1], end[fresh + 1]], axis=1))
        made += len(fresh)
        known_pairs, known_rules = np.r_[known_pairs, unique[~old]], np.r_[known_rules, names[~old]]
        order = np.argsort(known_pairs)
        known_pairs, known_rules = known_pairs[order], known_rules[order]
        rules.append(names[which])
        starts.append(start[places])
        symbols[places] = total + names[which]
        end[places] = end[places + 1]
        stays = np.ones(len(symbols), bool)
        stays[places + 1] = False
        symbols, doc, start, end = symbols[stays], doc[stays], start[stays], end[stays]
    # No pair repeats: neighbours are paired off until each document is one symbol.
    while len(start) > 1:
        joined = doc[1:] == doc[:-1]
        several = np.r_[joined, False] | np.r_[False, joined]
        doc, start, end = doc[several], start[several], end[several]
        if not len(doc):
            break
        head = np.r_[True, doc[1:] != doc[:-1]]
        place = np.arange(len(doc))
        place -= np.maximum.accumulate(np.where(head, place, 0))
        left = np.flatnonzero((place[:-1] % 2 == 0) & ~head[1:])
        bounds.append(np.stack([start[left], start[left + 1], end[left + 1]], axis=1))
        rules.append(made + np.arange(len(left)))
        starts.append(start[left])
        made += len(left)
        end[left] = end[left + 1]
        stays = np.ones(len(doc), bool)
        stays[left + 1] = False
        doc, start, end = doc[stays], start[stays], end[stays]
    if not bounds:
        return np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    assert made <= size
    return np.concatenate(bounds), np.concatenate(rules), np.concatenate(starts)


# The runs


def _single(words: np.ndarray, bounds: np.ndarray, min_words: int, min_periods: int) -> np.ndarray:
    """Runs of period 1 across the boundaries: (nonterminal, start, end, 1)."""
    start, at, end = bounds.T
    new = np.flatnonzero(np.r_[True, words[1:] != words[:-1], True])
    block = np.searchsorted(new, at, side="right") - 1
    x, y = np.maximum(new[block], start), np.minimum(new[block + 1], end)
    good = (words[at - 1] == words[at]) & (y - x >= max(min_words, min_periods))
    found = np.flatnonzero(good)
    return np.stack([found, x[found], y[found], np.ones(len(found), np.int64)], axis=1)


def _extended(words: np.ndarray, j: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch of period q around words j and j + q, which are equal, within [low, high)."""
    x, step = j, 64
    while x > low:
        part = max(low, x - step)
        differ = np.flatnonzero(words[part:x] != words[part + q:x + q])
        if len(differ):
            x = part + int(differ[-1]) + 1
            break
        x, step = part, step * 4
    y, step = j + 1, 64
    while y + q < high:
        part = min(high - q, y + step)
        differ = np.flatnonzero(words[y:part] != words[y + q:part + q])
        if len(differ):
            y += int(differ[0])
            break
        y, step = part, step * 4
    return x, y + q


def _distances(words: np.ndarray, bounds: np.ndarray, min_words: int, min_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nonterminal, period, anchor): periods over 1 that the words around a boundary allow, in bounded portions.

    ``anchor`` j: words j and j + period are known to be equal and both in the run, if there is one.
    """
    start, at, end = bounds.T
    most = (end - start) // min_periods
    wide = np.flatnonzero((most >= 2) & (end - start >= min_words))
    if not len(wide):
        return
    with np.errstate(over="ignore"):
        w = words.astype(np.uint64)
        mixed = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + w[2:]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(mixed, kind="stable")
    group = np.empty(len(mixed), np.int64)
    group[order] = np.cumsum(np.r_[False, mixed[order][1:] != mixed[order][:-1]])
    placed = group[order] * len(words) + order  # ascending: by group, then place
    for left in (True, False):
        t = at[wide] - (2 if left else 1)
        some = (t >= 0) & (t < len(mixed))
        rows, t = wide[some], t[some]
        base = group[t] * len(words)
        if left:
            a = np.searchsorted(placed, base + np.maximum(start[rows], t - most[rows]))
            b = np.searchsorted(placed, base + t - 1)
        else:
            a = np.searchsorted(placed, base + t + 2)
            b = np.searchsorted(placed, base + np.minimum(end[rows] - 3, t + most[rows]), side="right")
        counts = np.maximum(b - a, 0)
        some = np.flatnonzero(counts)
        rows, t, a, counts = rows[some], t[some], a[some], counts[some]
        before = np.cumsum(counts)
        cut = 0
        while cut < len(rows):
            stop = max(cut + 1, int(np.searchsorted(before, (before[cut - 1] if cut else 0) + TRIED, side="right")))
            part, n = slice(cut, stop), counts[cut:stop]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            other = order[np.repeat(a[part], n) + inside]
            row, own = np.repeat(rows[part], n), np.repeat(t[part], n)
            q = np.abs(own - other)
            # Two periods on this side, and words one period apart equal at nine places of them.
            j = at[row] - q if left else at[row] - 1
            good = (j - q >= start[row]) if left else (j + 2 * q < end[row])
            for eighth in range(9):
                row, q, j = row[good], q[good], j[good]
                p = j - q * eighth // 8 if left else j + q * eighth // 8
                p = np.maximum(p, at[row] - 2 * q) if left else np.minimum(p, at[row] + q - 1)
                good = words[p] == words[p + q]
            yield row[good], q[good], j[good]
            cut = stop


def runs_of(symbols: np.ndarray, doc: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """All runs of the documents: rows of (start, end, period), by start, then period.

    ``symbols``: words as dense numbers from 0 that differ between documents; ``doc`` ascending.
    """
    bounds, rule, place = grammar(symbols.copy(), doc)
    if not len(bounds):
        return np.empty((0, 3), np.int64)
    found = [_single(symbols, bounds, min_words, min_periods)]
    met: dict[int, list[tuple[int, int, int]]] = {}
    for row, x, y, q in found[0].tolist():
        met[row] = [(x, y, q)]
    if len(symbols) > 2:
        for rows, periods, anchors in _distances(symbols, bounds, min_words, min_periods):
            more, order = [], np.lexsort((periods, rows))
            for row, q, j in zip(rows[order].tolist(), periods[order].tolist(), anchors[order].tolist()):
                known = met.setdefault(row, [])
                # A multiple of a period found here, over a stretch at least as long, is the same run.
                if any(q % p == 0 and x <= j and j + q < y for x, y, p in known):
                    continue
                x, y = _extended(symbols, j, q, int(bounds[row, 0]), int(bounds[row, 2]))
                if y - x >= max(min_words, min_periods * q):
                    known.append((x, y, q))
                    more.append((row, x, y, q))
            if more:
                found.append(np.array(more, np.int64))
    found = np.concatenate(found)
    if not len(found):
        return np.empty((0, 3), np.int64)
    # To every place of derivation: the stretch moves with the nonterminal.
    order = np.argsort(rule, kind="stable")
    firsts = np.searchsorted(rule[order], found[:, 0])
    times = np.searchsorted(rule[order], found[:, 0], side="right") - firsts
    inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    shift = place[order][np.repeat(firsts, times) + inside] - np.repeat(bounds[found[:, 0], 0], times)
    x, y, q = (np.repeat(found[:, i], times) for i in (1, 2, 3))
    x, y = x + shift, y + shift
    # Stretches of one period inside another are pieces of it.
    order = np.lexsort((-y, x, q))
    x, y, q = x[order], y[order], q[order]
    ranked = np.cumsum(np.r_[False, q[1:] != q[:-1]]) * (len(symbols) + 1) + y
    whole = np.r_[True, ranked[1:] > np.maximum.accumulate(ranked)[:-1]]
    x, y, q = x[whole], y[whole], q[whole]
    # Of one stretch the smallest period.
    order = np.lexsort((q, y, x))
    x, y, q = x[order], y[order], q[order]
    least = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    out = np.stack([x[least], y[least], q[least]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _document_rows(min_words: int, min_periods: int, batch_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text")).cast(pa.binary())
            ids = batch.column(batch.schema.get_field_index("_id"))
            first, held, size = 0, [], 0
            for i, text in enumerate(texts):
                held.append(text.as_py().split())  # of bytes: the six ASCII white spaces
                size += len(held[-1])
                if size >= batch_words or i + 1 == len(ids):
                    if len(numbers) > MEMORY_WORDS:
                        numbers.clear()
                    yield _rows(ids[first:i + 1], held, numbers, min_words, min_periods)
                    first, held, size = i + 1, [], 0
    return run


def _rows(ids: pa.Array, texts: list[list[bytes]], numbers: dict, min_words: int, min_periods: int) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    if len(words):
        _, symbols = np.unique(doc << 32 | words, return_inverse=True)
        found = runs_of(symbols.astype(np.int64), doc, min_words, min_periods)
    else:
        found = np.empty((0, 3), np.int64)
    owner = doc[found[:, 0]] if len(found) else np.empty(0, np.int64)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 1], -1)
    dropped = np.cumsum(dropped) > 0
    collapsed = [b" ".join(t) for t in texts]
    for d in np.unique(owner).tolist():
        begin = int(ends[d] - sizes[d])
        collapsed[d] = b" ".join([w for w, gone in zip(texts[d], dropped[begin:int(ends[d])].tolist()) if not gone])
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    begin = (ends - sizes)[owner]
    runs = pa.StructArray.from_arrays(
        [pa.array(found[:, 0] - begin), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
        ["_id", "n_words", "runs", "collapsed"])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS,
    batch_words: int = BATCH_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, runs`` (start, length, period) ``, collapsed``.

    A run is a stretch of words of smallest period q and at least ``max(min_words, min_periods * q)`` words (4 periods or
    more) that no neighbouring word extends; runs come by start, then period.  ``collapsed`` holds the words, joined by
    blanks, without those that any run contains after its first q words.

    One pass without a shuffle.  Null and empty texts have no words and no runs; null and repeated ids are kept as they
    come, rows are independent of each other; a very long text is read whole and worked on by itself, in arrays of a few
    numbers per word; an empty table gives an empty table.
    """
    if min_periods < 4 or min_words < min_periods:
        raise ValueError("runs have at least 4 periods and as many words")
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = sent.mapInArrow(
        _document_rows(min_words, min_periods, batch_words), f"_id {id_type}, n_words long, runs {RUNS}, collapsed string")
    return out.select(F.col("_id").alias(id_col), "n_words", "runs", "collapsed")
