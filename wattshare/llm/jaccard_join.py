"""Near-duplicate texts by word shingles: an exact Jaccard join over parity sketches.

A document is the set of its distinct five-word shingles, each a 64-bit hash.  Sets of a size band share a sketch
layout of k segments.  A shingle belongs to one segment and flips its hash's bits there: a segment holds the XOR of its
shingles' hashes.  The segments in which two sketches differ number at most the symmetric difference D of the sets, and
Jaccard >= t bounds D by (1 - t) / (1 + t) of both sizes together.  Hence two linked sets agree in all segments but D
of those that are not empty: with more than D of them, some segment must be equal (the pigeonhole).  Sets that
the hash leaves with too few non-empty segments meet over single shingles as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshare.llm.common import BROADCAST_ROWS
from wattshare.llm.components import connected
from wattshare.session import staged, staged_alone, staged_tables

SHINGLE_WORDS, THRESHOLD_PERCENT = 5, 75
#: Bands grow by this factor; segments are this share of a band's upper size.
BAND_FACTOR, SEGMENT_SHARE = 3, 0.45
#: Words of 64 bits of the narrow sketch compared before sets are; a shingle flips one bit.
NARROW_WORDS = 8
#: Rounds that test few partners per document, and partners; a last round tests all pairs still open, so neither
#: bounds a result.
STAR_ROUNDS, STAR_TESTS = 5, 2
#: Keys by which the last round tells at which key a pair comes up; pairs that share none of these come up at each of theirs.
FIRST_KEYS = 8
#: Bytes of texts that are hashed together; bytes from which a word is hashed on its own; sets a worker remembers having sent.
CHUNK_BYTES, LONG_WORD, MEMORY_SETS = 500_000, 256, 200_000

# The multipliers of the finaliser.
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# Odd multipliers, one per place in a shingle; unrelated, or words that change places would give one sum.
_PLACE = _mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether each entry differs from the one before it; the first does."""
    out = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places, eight bytes of all words at a time; ``data`` has seven bytes to spare."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    out = _mixed(sizes.astype(np.uint64))
    places, rest = None, sizes  # None: all words
    at = starts
    while len(at):
        left = (8 * (8 - np.minimum(rest, 8))).astype(np.uint64)
        part = (eight[at] << left) >> left
        if places is None:
            out = _mixed(out * _M1 ^ part)
        else:
            out[places] = _mixed(out[places] * _M1 ^ part)
        more = np.flatnonzero((rest > 8) & (rest <= LONG_WORD))
        places = more if places is None else places[more]
        at, rest = at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(sizes > LONG_WORD):
        import xxhash

        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:starts[i] + sizes[i]])
    return out


def _sets_of(data: bytes, borders: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """``shingle_set`` of each of the texts that lie in ``data`` between neighbouring borders, hashed together."""
    raw = np.frombuffer(data.lower() + bytes(8), dtype=np.uint8)  # ASCII letters only
    if len(data) == 0:
        yield from (np.empty(0, dtype=np.uint64) for _ in borders[1:])
        return
    word = ~_IS_SPACE[raw[:len(data)]]
    # A word begins after white space or a border, and ends before such.
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = borders[(borders > 0) & (borders < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    hashed = _word_hashes(raw, starts, sizes)
    firsts = np.searchsorted(starts, borders)

    def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
        count = len(hashed) - width + 1
        total = np.full(count, width, dtype=np.uint64)
        for i in range(width):
            total += hashed[i:i + count] * _PLACE[i]
        return _mixed(total)

    with np.errstate(over="ignore"):
        every = shingles(hashed, words) if len(hashed) >= words else None
        for first, last in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            n = last - first
            if n == 0:
                yield np.empty(0, dtype=np.uint64)
                continue
            # Shingles across a border are passed over; a shorter text is one shingle.
            got = np.sort(every[first:last - words + 1] if n >= words else shingles(hashed[first:last], n))
            yield got[_changes(got)]


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of its shingles; A-Z count as a-z; a shorter text is one shingle, no words give none.

    Words are ended by ASCII white space; texts without nulls are hashed together, ``CHUNK_BYTES`` or one text at a time.
    """
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data, begin = texts.buffers()[2], 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, side="right")) - 1
        end = min(len(texts), max(begin + 1, end))
        part = data[int(offsets[begin]):int(offsets[end])].to_pybytes() if data is not None else b""
        yield from _sets_of(part, offsets[begin:end + 1] - offsets[begin], words)
        begin = end


def most_apart(small: int, large: int, percent: int = THRESHOLD_PERCENT) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (small + large) // (100 + percent)


def bands_of(size: int, percent: int = THRESHOLD_PERCENT) -> list[tuple[int, int, int, int]]:
    """(band, segments, most_apart, whether the lower one) of the one or two bands that a set takes part in.

    It meets its own band, and the one below if partners may lie there: those hold at least ``percent`` of its size.
    """
    band, low = 0, 1
    while low * BAND_FACTOR <= size:
        band, low = band + 1, low * BAND_FACTOR
    out = [(band, _segments(low * BAND_FACTOR), most_apart(size, 100 * size // percent, percent), 0)]
    if band and 100 * (low - 1) >= percent * size:
        out.append((band - 1, _segments(low), most_apart(low - 1, size, percent), 1))
    return out


def _segments(upper: int) -> int:
    return max(int(SEGMENT_SHARE * upper) + 1, min(2 * upper, 32))


def sketch_keys(hashes: np.ndarray, band: int, segments: int) -> np.ndarray:
    """One 64-bit key for each segment that is not empty: band, segment and the XOR of its shingles; ``hashes`` are sorted."""
    with np.errstate(over="ignore"):
        # Segments are ranges of hashes, so theirs are in order as well.
        place = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        firsts = np.flatnonzero(_changes(place))
        xors = np.bitwise_xor.reduceat(_mixed(hashes), firsts)
        return _mixed(xors + _mixed(place[firsts] + np.uint64((band + 1) << 40)))


def _digest(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def _class_of(digest: bytes, turn: int = 0) -> int:
    """Class number: 63 bits; the lowest is kept free to mark keys of the lower band.  Each turn takes other bits."""
    import xxhash

    if turn:
        digest = xxhash.xxh3_64_digest(digest, seed=turn)
    return int.from_bytes(digest[:8], "little", signed=True) & ~1


def _sets(percent: int, words: int, keys: bool, turn: int = 0):
    """Arrow mapper.  Without ``keys``: id, digest, class, size.  With: class, size, slack, keys (see ``_key_rows``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            sets = shingle_sets(batch.column(batch.schema.get_field_index("_text")), words)
            if not keys:
                digests, classes, sizes = [], [], []
                for hashes in sets:
                    digest = _digest(hashes)
                    digests.append(digest)
                    classes.append(_class_of(digest, turn))
                    sizes.append(len(hashes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("_id")), pa.array(digests, pa.binary()),
                     pa.array(classes, pa.int64()), pa.array(sizes, pa.int32())], ["_id", "_set", "_cls", "_n"])
                continue
            owners, sizes, slacks, values = [], [], [], []
            for hashes in sets:
                if not len(hashes):
                    continue
                owner = _class_of(_digest(hashes), turn)
                if owner in sent:
                    continue
                if len(sent) >= MEMORY_SETS:
                    sent.clear()
                sent.add(owner)
                for band, segments, apart, lower in bands_of(len(hashes), percent):
                    got = sketch_keys(hashes, band, segments)
                    slack = len(got) - apart - 1
                    if slack < 0:  # too few segments: single shingles as further keys
                        with np.errstate(over="ignore"):
                            got = np.concatenate([got, _mixed(hashes + np.uint64((band + 1) << 20))])
                    owners.append(owner | lower)
                    sizes.append(len(hashes))
                    slacks.append(slack)
                    values.append(got.view(np.int64))
            offsets = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum([len(v) for v in values], out=offsets[1:])
            flat = np.concatenate(values) if values else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), pa.array(sizes, pa.int32()), pa.array(slacks, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["_own", "_n", "_slack", "_keys"])
    return run


def _full_sets(words: int, turn: int = 0):
    """Arrow mapper: class, size, sorted hashes and the narrow sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(batch.schema.get_field_index("_text")), words))
            width = 64 * NARROW_WORDS
            bits = [np.packbits((np.bincount((s % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(bool))
                    .view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class_of(_digest(s), turn) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                 pa.array(bits, pa.list_(pa.int64()))], ["_cls", "_n", "_hashes", "_bits"])
    return run


def _shared_keys(texts: DataFrame, percent: int, words: int, turn: int = 0) -> DataFrame:
    """``_key, _own, _n, _slack`` of keys that several classes have, and how many (``_freq``); one shuffle of key rows.

    Tasks send each class once however many copies they read; within a key rows are sorted by owner, and a look at both
    neighbours tells whether another class is there, so keys are streamed, not gathered.
    """
    sent = texts.mapInArrow(_sets(percent, words, True, turn), "_own long, _n int, _slack int, _keys array<long>")
    rows = sent.select("_own", "_n", "_slack", F.explode("_keys").alias("_key"))
    near = Window.partitionBy("_key").orderBy("_own")
    before, after = F.lag("_own").over(near), F.lead("_own").over(near)
    met = rows.select("*", before.alias("_before"), after.alias("_after"))
    # Repeats of the same owner (copies read by other tasks) give one row.
    fresh = F.col("_before").isNull() | (F.col("_before") != F.col("_own"))
    other = F.col("_before").isNotNull() | (F.col("_after") != F.col("_own"))
    kept = met.filter(fresh & (other | (F.col("_after") == F.col("_own")))).select("_key", "_own", "_n", "_slack")
    return kept.withColumn("_freq", F.count(F.lit(1)).over(Window.partitionBy("_key"))).filter("_freq > 1")


def _several(rows: DataFrame) -> DataFrame:
    """Rows of keys that still have two owners, with the number of owners."""
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_freq")).filter("_freq > 1")
    return rows.drop("_freq").join(counts, "_key")


def _enough(rows: DataFrame) -> DataFrame:
    """Rows of owners that share more keys than their slack; an owner is bounded by its document."""
    count = F.count(F.lit(1)).over(Window.partitionBy("_own"))
    return rows.withColumn("_shared", count).filter(F.col("_shared") > F.col("_slack")).drop("_shared")


def _rarest(rows: DataFrame) -> DataFrame:
    """All keys of an owner but its ``_slack`` most frequent ones, which no link needs.

    Linked owners share all non-empty segments but ``most_apart``, so in one order of keys for everyone each of them
    finds a shared one among its rarest ``most_apart + 1``: passages that very many texts contain drop out unless a text
    consists of them.  An owner is bounded by its document.
    """
    rank = F.row_number().over(Window.partitionBy("_own").orderBy(F.desc("_freq"), "_key"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") > F.col("_slack")).drop("_rank")


def _apart(left: str, right: str) -> Column:
    """Bits in which two narrow sketches differ: at most the symmetric difference of the sets."""
    words = [F.bit_count(F.get(left, i).bitwiseXOR(F.get(right, i))) for i in range(NARROW_WORDS)]
    return reduce(lambda x, y: x + y, words)


def _may_link(left: str, right: str, percent: int) -> Column:
    """Sizes and narrow sketches of ``_n<left>, _b<left>`` and ``_n<right>, _b<right>`` allow a link."""
    a, b = F.col(f"_n{left}"), F.col(f"_n{right}")
    sized = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    return sized & (_apart(f"_b{left}", f"_b{right}") * F.lit(100 + percent) <= F.lit(100 - percent) * (a + b))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are linked: sizes and narrow sketches first, then the sets themselves."""
    left = sets.select(F.col("_cls").alias("a"), F.col("_n").alias("_na"), F.col("_hashes").alias("_ha"), F.col("_bits").alias("_ba"))
    right = sets.select(F.col("_cls").alias("b"), F.col("_n").alias("_nb"), F.col("_hashes").alias("_hb"), F.col("_bits").alias("_bb"))
    met = pairs.join(left, "a").join(right, "b")
    fits = _may_link("a", "b", percent)
    same = F.when(fits, F.size(F.array_intersect("_ha", "_hb"))).otherwise(0)
    return met.withColumn("_same", same).filter(
        fits & (F.lit(100) * F.col("_same") >= F.lit(percent) * (F.col("_na") + F.col("_nb") - F.col("_same")))).select("a", "b")


def _links(shared: DataFrame, sets: DataFrame, percent: int, rounds: int = STAR_ROUNDS) -> DataFrame:
    """Links that join all classes which any links join.

    Star rounds test each class against few others, one from each of its keys where labels still differ (first the
    one that shares most, then any), and each link makes two labels one: groups of many near copies collapse after
    few tests.  Equal labels mean connected, and keys whose classes all have one label leave.  The last round tests every pair
    that shares a key and differs in label, so whatever the rounds left is settled; narrow sketches are compared inside
    that join, before it yields a row, and a pair is made at the least of its common first keys alone.
    """
    # rows: one per key and class; labels ride along.
    rows = staged(shared.select("_key", F.col("_own").bitwiseAND(F.lit(~1)).alias("_cls"), "_n", "_freq"), "near-keys")
    labels = staged(rows.groupBy("_cls").agg(F.sum("_freq").alias("_deg")).withColumn("_lab", F.col("_cls")), "near-labels")
    found: list[DataFrame] = []
    for turn in range(rounds):
        named = rows.join(labels, "_cls")
        order = F.xxhash64("_cls", F.lit(turn)) if turn else -F.col("_deg")
        stars = named.groupBy("_key").agg(
            F.min("_lab").alias("_lo"), F.max("_lab").alias("_hi"),
            F.min(F.struct(order.alias("o"), F.col("_cls").alias("c"), F.col("_lab").alias("l"), F.col("_n").alias("n"))).alias("_star"),
        ).filter("_lo <> _hi").select("_key", "_star")
        if turn:
            # Labels only ever merge: keys that are closed now stay closed.
            stars = staged(stars, "near-stars")
            rows = staged(rows.join(stars.select("_key"), "_key", "left_semi"), "near-keys")
        options = named.join(stars, "_key").filter(
            (F.col("_lab") != F.col("_star.l"))
            & (100 * F.least("_n", "_star.n") >= percent * F.greatest("_n", "_star.n")))
        shares = options.groupBy("_cls", "_lab", "_star.c", "_star.l").agg(F.count(F.lit(1)).alias("_k"))
        # A class has no more options than its document has keys.
        rank = F.row_number().over(Window.partitionBy("_cls").orderBy(F.desc("_k"), "c"))
        tests = staged(shares.withColumn("_rank", rank).filter(F.col("_rank") <= STAR_TESTS).select(
            F.col("c").alias("a"), F.col("_cls").alias("b"), F.col("l").alias("_la"), F.col("_lab").alias("_lb")), "near-tests")
        good = staged(_verified(tests.select("a", "b"), sets, percent), "near-links")
        if good.isEmpty():
            break
        found.append(good)
        # Every label goes over to the least one that a link ties it to.
        moves = good.join(tests, ["a", "b"]).groupBy(F.greatest("_la", "_lb").alias("_lab")).agg(
            F.min(F.least("_la", "_lb")).alias("_new"))
        labels = staged(labels.join(moves, "_lab", "left").select(
            "_cls", "_deg", F.coalesce("_new", "_lab").alias("_lab")), "near-labels")
    # What is still open: pairs on a key, one of them outside the key's main label.
    named = staged(rows.drop("_freq").join(labels.drop("_deg"), "_cls"), "near-named")
    tally = named.groupBy("_key", "_lab").agg(F.count(F.lit(1)).alias("_k"))
    main = tally.groupBy("_key").agg(
        F.max(F.struct("_k", "_lab")).alias("_m"), F.count(F.lit(1)).alias("_labs")).filter("_labs > 1").select(
        "_key", F.col("_m._lab").alias("_main"))
    still = staged(named.join(main, "_key"), "near-still")
    # A class has no more keys than its document has shingles.
    firsts = still.groupBy("_cls").agg(F.slice(F.sort_array(F.collect_list("_key")), 1, FIRST_KEYS).alias("_fy"))
    open_rows = staged(still.join(firsts, "_cls").join(sets.select("_cls", F.col("_bits").alias("_by")), "_cls").select(
        "_key", F.col("_cls").alias("y"), F.col("_lab").alias("_ly"), F.col("_n").alias("_ny"), "_by", "_fy", "_main"), "near-open")
    apart = open_rows.filter("_ly <> _main").select(
        F.col("_key").alias("_kx"), F.col("y").alias("x"), F.col("_ly").alias("_lx"), F.col("_ny").alias("_nx"), F.col("_by").alias("_bx"),
        F.col("_fy").alias("_fx"), F.col("_main").alias("_mx"))
    # Both outside the main label: the pair comes up twice, take the half with x < y.
    once = (F.col("_ly") == F.col("_mx")) | (F.col("x") < F.col("y"))
    # A shared key of two labels is open, so both classes have a row for the least one.
    least = F.array_min(F.array_intersect("_fx", "_fy"))
    pairs = apart.join(open_rows.drop("_main"), (F.col("_kx") == F.col("_key")) & (F.col("_lx") != F.col("_ly")) & once
                       & _may_link("x", "y", percent) & F.coalesce(least == F.col("_kx"), F.lit(True))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found.append(staged(_verified(pairs, sets, percent), "near-links"))
    return reduce(DataFrame.unionByName, found)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT,
    words: int = SHINGLE_WORDS, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id``.

    Two rows link when the Jaccard similarity of their shingle sets is at least ``percent``; ``component_id`` is the
    smallest id reachable by links, its own included.  Equal sets are one class and join as one, so copies cost nothing
    but their scan; links between classes are complete (see the module's head), compared by 64-bit hashes.

    Texts are read three times: for the classes of all rows, for the keys of all classes, and for the sets of
    those classes alone that share enough keys with another.  Texts enter no shuffle unless these are more than
    ``broadcast_rows``.

    Null or empty texts and texts of white space have no shingles and link with nothing; a null id is never the
    smallest unless all are; rows that repeat an id are rows of their own; an empty table gives an empty table.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    turn = 0
    while True:
        rows = staged(texts.mapInArrow(
            _sets(percent, words, False, turn), f"_id {id_type}, _set binary, _cls long, _n int"), "near-rows")
        classes = staged(rows.filter("_n > 0").groupBy("_set").agg(
            F.min("_id").alias("_first"), F.min("_cls").alias("_cls")), "near-classes")
        # Digests of 128 bits tell sets apart; should two share a class number, all get others.
        if classes.groupBy("_cls").count().filter("count > 1").isEmpty():
            break
        turn += 1
    # Each of these tables is a part of the one before, which then goes.
    since = staged_tables(docs.sparkSession)
    shared = staged(_shared_keys(texts.select("_text"), percent, words, turn), "near-shared")
    # Twice: owners without enough shared keys leave, which makes further keys unshared.
    shared = staged_alone(_enough(shared), "near-shared", since)
    shared = staged_alone(_enough(_several(shared)), "near-shared", since)
    shared = staged_alone(_several(_rarest(_several(shared))), "near-rarest", since)
    wanted = shared.select(F.col("_own").bitwiseAND(F.lit(~1)).alias("_cls")).distinct()
    chosen = staged(classes.join(wanted, "_cls", "left_semi").select(F.col("_first").alias("_id")), "near-chosen")
    few = chosen.limit(broadcast_rows + 1).count() <= broadcast_rows
    ids = chosen.withColumnRenamed("_id", "_chosen")
    read = texts.join(F.broadcast(ids) if few else ids, F.col("_id").eqNullSafe(F.col("_chosen")), "left_semi")
    sets = staged(read.mapInArrow(
        _full_sets(words, turn), "_cls long, _n int, _hashes array<long>, _bits array<long>").dropDuplicates(["_cls"]), "near-sets")
    roots = connected(_links(shared, sets, percent))
    named = classes.join(roots, F.col("_cls") == F.col("node"), "left").select(
        "_set", "_first", F.coalesce("root", "_cls").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_first").alias("_least"))
    component = named.join(least, "_root").select("_set", "_least")
    return rows.join(component, "_set", "left").select(
        F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_shingles"),
        F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("_id")).alias("component_id"))
