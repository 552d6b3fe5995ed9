"""Phrase collocations: n-grams counted in counting quotient filters, scored by their weakest cut.

A phrase is packed from the ids of its words into a number of fixed width (several 64-bit lanes if it is wide).  An
invertible permutation spreads these numbers evenly; the top bits of the image name a range, the next ones a quotient,
and the rest, the remainder, is stored in full: nothing is lost, the number is recovered from its place and its
remainder.  A filter holds its entries in order, quotients as one bit each (occupied) and one bit per entry (end of a
quotient's run), counters in a byte with longer ones aside.  Tasks build filters, ranges are dealt by one shuffle, and
filters of a range merge as the sorted lists they are.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshare.session import staged

MAX_WORDS, MIN_COUNT, ABSORBED_PERCENT, SCALE, TOP = 3, 10, 50, 1_000_000, 2000
#: Frequent words up to which every task is sent their ids; beyond it ids are 64-bit hashes proven free of clashes.
VOCABULARY_ROWS = 1_000_000
#: Distinct words a task counts before it hands them on; entries of a filter before it does so; entries of a merged range.
MEMORY_WORDS, FILTER_ENTRIES, RANGE_ENTRIES = 500_000, 6_000_000, 1_500_000
#: Rows ranked by one task.
RANKED_ROWS = 100_000
UNKNOWN_LANG = "und"

# Capitals, signs that end a piece (all read as a full stop), odd multipliers.
_CAPITALS, _ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b",;:!?\n\x0b\x0c\r"
_READ = bytes.maketrans(_CAPITALS + _ENDS, _CAPITALS.lower() + b"." * len(_ENDS))
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), a full stop wherever a piece ends."""
    return text.translate(_READ).replace(b".", b" . ").split()


# Packing and permuting


def lanes_of(ids: np.ndarray, known: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """The n-grams of known words only, as 64-bit lanes of as many words as fit, first words first."""
    per, out = 64 // bits, []
    count = len(ids) - n + 1
    if count <= 0:
        return [np.empty(0, np.uint64) for _ in range(-(-n // per))]
    whole = np.flatnonzero(reduce(np.logical_and, [known[i:i + count] for i in range(n)]))
    for first in range(0, n, per):
        lane = np.zeros(len(whole), np.uint64)
        for i in range(first, min(n, first + per)):
            lane = (lane << np.uint64(bits) if bits < 64 else lane) | ids[whole + i]
        out.append(lane)
    return out


def lane_bits(n: int, bits: int) -> int:
    """Bits of the first lane."""
    return bits * min(n, 64 // bits)


def _shuffled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD[1])
    return x ^ (x >> np.uint64(29))


def _offset(lanes: list[np.ndarray]) -> np.ndarray:
    """What the further lanes add to the first."""
    total = np.zeros(len(lanes[0]), np.uint64)
    for lane in lanes[1:]:
        total = _shuffled(total + lane + np.uint64(1))
    return total


def permuted(lanes: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The first lane under a permutation of its ``width`` bits that depends on the other lanes."""
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    with np.errstate(over="ignore"):
        x = (lanes[0] + _offset(lanes)) & mask
        for odd in _ODD:
            x = ((x ^ (x >> half)) * np.uint64(odd)) & mask
        return [x ^ (x >> half), *lanes[1:]]


def restored(lanes: list[np.ndarray], width: int) -> list[np.ndarray]:
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    with np.errstate(over="ignore"):
        x = lanes[0] ^ (lanes[0] >> half)
        for odd in reversed(_ODD):
            x = (x * np.uint64(pow(odd, -1, 1 << 64))) & mask
            x = x ^ (x >> half)
        return [(x - _offset(lanes)) & mask, *lanes[1:]]


def ids_of(lanes: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    """The ids of the words, one array per place."""
    per, mask, out = 64 // bits, np.uint64((1 << bits) - 1), []
    for place in range(n):
        inside, in_lane = place % per, min(per, n - place // per * per)
        out.append((lanes[place // per] >> np.uint64(bits * (in_lane - 1 - inside))) & mask)
    return out


# Filters


def merged(lanes: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries in order, equal ones as one with the sum of their counters (``None``: one each)."""
    if not len(lanes[0]):
        return lanes, np.empty(0, np.int64)
    if len(lanes) == 1 and counts is None:
        lanes = [np.sort(lanes[0])]
    else:
        # Stable sorting of joined sorted lists is a merge.
        order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
        lanes = [lane[order] for lane in lanes]
        counts = None if counts is None else counts[order]
    new = np.ones(len(lanes[0]), bool)
    new[1:] = reduce(np.logical_or, [lane[1:] != lane[:-1] for lane in lanes])
    firsts = np.flatnonzero(new)
    totals = np.diff(np.r_[firsts, len(new)]) if counts is None else np.add.reduceat(counts, firsts)
    return [lane[firsts] for lane in lanes], totals.astype(np.int64)


# Entries, bits of a quotient, bytes of a remainder, counters of 255 and more.
_HEAD = "<IBBI"


def encoded(lanes: list[np.ndarray], counts: np.ndarray, width: int) -> bytes:
    """A filter over the low ``width`` bits of the first lane (the range's bits are known from elsewhere)."""
    n = len(counts)
    kept = max(0, -(-(width - max(1, n).bit_length()) // 8))  # bytes of a remainder; about a quotient per entry
    q = max(0, width - 8 * kept)
    low = lanes[0] & np.uint64((1 << width) - 1)
    quotient = (low >> np.uint64(8 * kept)).astype(np.int64) if kept < 8 else np.zeros(n, np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.r_[quotient[1:] != quotient[:-1], True]
    remainder = low.astype("<u8").view(np.uint8).reshape(n, 8)[:, :kept]
    large = counts[counts >= 255].astype("<u8")
    return b"".join([
        struct.pack(_HEAD, n, q, kept, len(large)), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainder.tobytes(),
        *[lane.astype("<u8").tobytes() for lane in lanes[1:]], np.minimum(counts, 255).astype(np.uint8).tobytes(), large.tobytes()])


def decoded(blob: bytes, lanes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries and counters; the first lane without its range's bits."""
    n, q, kept, large = struct.unpack_from(_HEAD, blob)
    at = struct.calcsize(_HEAD)

    def take(size: int, kind=np.uint8) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at)
        at += size
        return part

    occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
    ends = np.unpackbits(take(-(-n // 8)), count=n)
    quotient = occupied[np.r_[0, np.cumsum(ends[:-1])].astype(np.int64)]
    remainder = np.zeros((n, 8), np.uint8)
    remainder[:, :kept] = take(n * kept).reshape(n, kept)
    first = remainder.view("<u8").reshape(n).astype(np.uint64)
    if kept < 8:
        first |= quotient.astype(np.uint64) << np.uint64(8 * kept)
    others = [take(8 * n, "<u8").astype(np.uint64) for _ in range(lanes - 1)]
    counts = take(n).astype(np.int64)
    counts[counts == 255] = take(8 * large, "<u8").astype(np.int64)
    return [first, *others], counts


class _Grams:
    """The n-grams of one length that a task has met: unsorted ones and merged filters, in bounded memory."""

    def __init__(self, n: int, bits: int, range_bits: int, most: int):
        self.n, self.bits, self.width = n, bits, lane_bits(n, bits)
        self.range_bits, self.most = min(range_bits, self.width), most
        self._new: list[list[np.ndarray]] = []
        self._held: list[tuple[list[np.ndarray], np.ndarray]] = []

    def add(self, ids: np.ndarray, known: np.ndarray) -> None:
        self._new.append(lanes_of(ids, known, self.n, self.bits))
        if sum(len(lanes[0]) for lanes in self._new) >= self.most:
            self._settle()

    def _settle(self) -> None:
        if self._new:
            lanes = [np.concatenate(parts) for parts in zip(*self._new)]
            self._held.append(merged(permuted(lanes, self.width), None))
            self._new = []

    def full(self) -> bool:
        return sum(len(c) for _, c in self._held) >= self.most

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """(words, range, filter) of all that is held, which is then forgotten."""
        self._settle()
        if not self._held:
            return
        lanes, counts = self._held[0] if len(self._held) == 1 else merged(
            [np.concatenate(p) for p in zip(*[h[0] for h in self._held])], np.concatenate([h[1] for h in self._held]))
        self._held = []
        low = self.width - self.range_bits
        ranges = (lanes[0] >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(len(counts), np.int64)
        stops = np.flatnonzero(np.r_[ranges[1:] != ranges[:-1], len(ranges) > 0]) + 1
        start = 0
        for stop in stops.tolist():
            yield self.n, int(ranges[start]), encoded([lane[start:stop] for lane in lanes], counts[start:stop], low)
            start = stop


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    texts = batch.column(batch.schema.get_field_index("_text")).cast(pa.binary()).to_pylist()
    return zip(batch.column(batch.schema.get_field_index("_lang")).to_pylist(), texts)


def _word_counts(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, words in counts.items() for word, n in words.items() if word != b"."]
            counts.clear()
            langs, words, ns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())],
                ["lang", "word", "f"])

        for batch in batches:
            for lang, text in _columns(batch):
                counts[lang].update(tokens(text))
                if len(counts[lang]) >= memory:
                    yield flush()
            if sum(map(len, counts.values())) >= memory:
                yield flush()
        yield flush()
    return run


class _HashIds(dict):
    """64-bit ids of a language's words as Spark's ``xxhash64`` gives them for ``_hashed``."""

    def __init__(self, lang: str, turn: int, memory: int):
        self._prefix, self._memory = f"{turn}\0{lang}\0".encode(), memory

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self._memory:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(self._prefix + word, seed=42)
        return value


def _hashed(turn: int) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{turn}\0"), F.col("lang"), F.lit("\0"), F.col("word")))


def _gram_rows(ids, turn: int, bits: int, max_words: int, range_bits: int, most: int, memory: int):
    """Arrow mapper: (words, range, filter).  ``ids``: broadcast ids by language and word, or None for hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = [_Grams(n, bits, range_bits, most) for n in range(2, max_words + 1)]
        hashes: dict[str, _HashIds] = {}

        def numbers(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """Ids and whether they are known; the place after a text never is."""
            if ids is not None:
                dense = np.fromiter(map(ids.value.get(lang, {}).get, words, repeat(-1)), np.int64, len(words))
                return np.append(dense, 0).astype(np.uint64), np.append(dense >= 0, False)
            named = hashes.setdefault(lang, _HashIds(lang, turn, memory))
            hashed = np.array([*map(named.__getitem__, words), 0], np.uint64)
            return hashed, np.array([*map(b".".__ne__, words), False])

        def sent(rows) -> Iterator[pa.RecordBatch]:
            for row in rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.binary())],
                    ["_n", "_range", "_filter"])

        def take(parts: list) -> None:
            numbered, known = (np.concatenate(p) for p in zip(*parts))
            for g in grams:
                g.add(numbered, known)

        for batch in batches:
            parts, size = [], 0
            for lang, text in _columns(batch):
                parts.append(numbers(lang, tokens(text)))
                size += len(parts[-1][0])
                if size >= most // 4:
                    take(parts)
                    parts, size = [], 0
            if parts:
                take(parts)
            for g in grams:
                if g.full():
                    yield from sent(g.rows())
        for g in grams:
            yield from sent(g.rows())
    return run


def _frequent(widths: Mapping[int, int], range_bits: int, min_count: int, bits: int, most: int):
    """Arrow mapper over filters sorted by (words, range): (ids, count) of the entries that reach ``min_count``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def joined() -> tuple[list[np.ndarray], np.ndarray]:
            if len(held) == 1:
                return held[0]
            return merged([np.concatenate(p) for p in zip(*[h[0] for h in held])], np.concatenate([h[1] for h in held]))

        def finish() -> pa.RecordBatch:
            n, number = now
            lanes, counts = joined()
            often = counts >= min_count
            width = widths[n]
            low = width - min(range_bits, width)
            lanes, counts = [lane[often] for lane in lanes], counts[often]
            if low < 64:
                lanes[0] = lanes[0] | np.uint64(number << low)
            ids = np.stack(ids_of(restored(lanes, width), n, bits), axis=1).reshape(-1).view(np.int64)
            offsets = np.arange(0, len(ids) + 1, n, dtype=np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(counts, pa.int64())], ["g", "a"])

        for batch in batches:
            for n, number, blob in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (n, number) != now:
                    if now is not None:
                        yield finish()
                    now, held, size = (n, number), [], 0
                lanes = -(-n // (64 // bits))
                held.append(decoded(blob, lanes))
                size += len(held[-1][1])
                if size >= most and len(held) > 1:
                    held = [joined()]
                    size = len(held[0][1]) // 2  # what merging could not reduce must grow by half before the next
        if now is not None:
            yield finish()
    return run


# The operator


def _numbered(words: DataFrame, rows: int) -> DataFrame:
    """Dense ids from 0: rows within hash parts, parts by their counts."""
    parts = max(1, rows // 20_000)
    spread = words.withColumn("_part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy("lang", "word")) - 1
    return spread.withColumn("_number", number).join(firsts, "_part").select(
        "lang", "word", "f", (F.col("_first") + F.col("_number")).cast("long").alias("id"))


def _score(a: str, left: str, right: str, scale: int) -> Column:
    """floor(scale · a² / (l · r)) in decimals of 38 digits."""
    return F.expr(f"(CAST({scale} AS DECIMAL(9, 0)) * CAST({a} AS DECIMAL(14, 0)) * CAST({a} AS DECIMAL(14, 0)))"
                  f" div (CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(19, 0)))")


def _ranked(scored: DataFrame, top: int, rows: int) -> DataFrame:
    """The first ``top`` of each language: within hash parts first, ever fewer of them."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = max(1, rows // RANKED_ROWS)
    while parts > 1:
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        place = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
        scored = scored.withColumn("rank", place).filter(F.col("rank") <= top).drop("rank")
        parts //= 32
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return scored.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
    absorbed_percent: int = ABSORBED_PERCENT, scale: int = SCALE, top: int = TOP, vocabulary_rows: int = VOCABULARY_ROWS,
    filter_entries: int = FILTER_ENTRIES, range_entries: int = RANGE_ENTRIES,
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Words are lower-cased (A-Z), pieces end at ``.,;:!?`` and line ends.  ``n``: words of the language; ``a``: how often the
    phrase of 2 to ``max_words`` words occurs within pieces, at least ``min_count``.  A phrase cut after its first words
    occurs as parts ``l`` and ``r`` times; its lowest score over all cuts, floor(scale · a² / (l · r)), counts, the earliest
    of equal cuts.  Phrases inside a longer one with at least ``absorbed_percent`` of their occurrences are dropped.
    Ties of score and count are ranked by the phrase's bytes.

    Only words that occur ``min_count`` times can be part of such a phrase, so only these get ids and all others
    end a gram.  Up to ``vocabulary_rows`` of them every task is sent dense ids; beyond, all words get 64-bit
    hashes, checked over the whole vocabulary and drawn anew until no two words share one.  Texts are read twice; the
    shuffle carries filters, of which a very common phrase is one entry per task.

    Null texts are empty and have no words; a null language is ``und``; repeated rows count as often as they
    occur; very long texts are read whole; an empty table gives no rows.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("_lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    counted = texts.mapInArrow(_word_counts(MEMORY_WORDS), "lang string, word string, f long")
    words = staged(counted.groupBy("lang", "word").agg(F.sum("f").alias("f")), "phrase-words")
    sizes = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-sizes")
    often = words.filter(F.col("f") >= min_count)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = often.limit(vocabulary_rows + 1).count()
    if rows <= vocabulary_rows:
        turn, bits = 0, max(1, rows.bit_length())
        vocabulary = staged(_numbered(often, rows), "phrase-vocabulary")
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, word, number in vocabulary.select("lang", "word", "id").toLocalIterator():
            known[lang][word.encode()] = number
        ids = docs.sparkSession.sparkContext.broadcast(dict(known))
    else:
        turn, bits, ids = 0, 64, None
        while not words.groupBy(_hashed(turn)).count().filter("count > 1").isEmpty():
            turn += 1
        vocabulary = staged(often.withColumn("id", _hashed(turn)), "phrase-vocabulary")
    range_bits = max(0, (total * (max_words - 1) // range_entries).bit_length())
    filters = texts.mapInArrow(
        _gram_rows(ids, turn, bits, max_words, range_bits, filter_entries, MEMORY_WORDS), "_n int, _range long, _filter binary")
    dealt = filters.repartition("_n", "_range").sortWithinPartitions("_n", "_range")
    widths = {n: lane_bits(n, bits) for n in range(2, max_words + 1)}
    grams = staged(dealt.mapInArrow(
        _frequent(widths, range_bits, min_count, bits, filter_entries), "g array<long>, a long"), "phrase-grams")

    # Level by level: names and counts of the parts are known when a phrase of n words is met.
    levels = {1: vocabulary.select(F.array("id").alias("g"), F.col("f").alias("a"), "lang", F.col("word").alias("phrase"))}
    for n in range(2, max_words + 1):
        level = grams.filter(F.size("g") == n)
        for k in range(1, n):
            left = levels[k].select(F.col("g").alias("_left"), F.col("a").alias(f"_l{k}"), *(
                ["lang", F.col("phrase").alias("_head")] if k == 1 else []))
            right = levels[n - k].select(F.col("g").alias("_right"), F.col("a").alias(f"_r{k}"), *(
                [F.col("phrase").alias("_tail")] if k == 1 else []))
            level = level.withColumns({"_left": F.slice("g", 1, k), "_right": F.slice("g", k + 1, n - k)}).join(
                left, "_left").join(right, "_right").drop("_left", "_right")
        cuts = [F.struct(_score("a", f"_l{k}", f"_r{k}", scale).alias("score"), F.lit(k).alias("k"),
                         F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")) for k in range(1, n)]
        weakest = cuts[0] if n == 2 else F.least(*cuts)
        levels[n] = staged(level.select(
            "g", "a", "lang", F.concat_ws(" ", "_head", "_tail").alias("phrase"), weakest.alias("_cut")), f"phrase-level{n}")
    kept = []
    for n in range(2, max_words + 1):
        level = levels[n]
        if n < max_words:
            # A longer phrase that holds this one holds it within some phrase of one more word, at least as frequent.
            inside = levels[n + 1].select("a", F.explode(F.array(F.slice("g", 1, n), F.slice("g", 2, n))).alias("g"))
            most = inside.groupBy("g").agg(F.max("a").alias("_most"))
            level = level.join(most, "g", "left").filter(
                F.col("_most").isNull() | (100 * F.col("_most") < F.lit(absorbed_percent) * F.col("a"))).drop("_most")
        kept.append(level.select("lang", "phrase", "a", "_cut.l", "_cut.r", F.col("_cut.score").cast("long").alias("score")))
    scored = staged(reduce(DataFrame.unionByName, kept), "phrase-scored")
    first = _ranked(scored, top, scored.count())
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
