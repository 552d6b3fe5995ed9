"""Repeated and nearly repeated lines: a segment-partition edit join, in DataFrame functions only.

Lines within e edits of each other agree in one of e + 1 segments, up to a small shift; e grows with the length.  Lines are
indexed by their segments (with length and segment number) and probe the index by their own substrings of the
lengths that partners may have; what meets is verified by a bit-parallel edit distance over a diagonal band.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshare.llm.common import BROADCAST_ROWS, if_small, text_or_empty
from wattshare.session import staged, staged_alone, staged_tables

#: Edits between near lines, as (characters from which they hold for the shorter line, edits): one for 30 characters, 5 at most.
MAX_EDITS = ((0, 1), (60, 2), (90, 3), (120, 4), (150, 5))
#: Characters from which a line is looked at; share of a document's characters above which its repeated lines mean a copy
#: rather than boilerplate.
MIN_CHARS, COPY_SHARE = 24, 0.5
#: Index lines of a key up to which all are compared, by their letter codes inside the join; larger keys are split by further
#: segments first, so often at most.  A split makes a row for each place of ``probe_codes``, as dear as some hundred comparisons.
SMALL_KEY, MOST_SPLITS = 512, 4
#: Bits for each index key in the bitmap that probes are tested against before they are shuffled, and most bits (as a power of
#: two): 16 MB for all keys and as much for those of several lines.  With more keys false hits only lengthen the join.
KEY_BITS, MOST_BITS = 20, 27
#: Letters counted before a pair is verified, so many to a number; any would do, frequent ones tell most.  Places at which lines
#: are cut for that.  Keys of a line that are looked through so that a pair is made at one of them alone.
COUNTED, TO_A_NUMBER, CUTS, FIRST_KEYS = " aeinorstbcdfghjklmpquvwxyz.,0123456789", 15, 7, 128
#: Edits whose states fit one number of 64 bits.
MOST_PACKED = 5
#: Letters read between two looks at the states; log2 of the longest common beginning or end cut off at once; pairs
#: verified by one task.
BLOCK, MOST_COMMON, PAIRS_OF_TASK = 16, 20, 2_000


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``_id, _no, _line, _h``: lines long enough, each with its place and 64-bit hash."""
    split = F.split(text_or_empty(F.col(text_col)), "\n", -1)
    rows = docs.select(F.col(id_col).alias("_id"), F.posexplode(split).alias("_no", "_line"))
    return rows.filter(F.length("_line") >= min_chars).withColumn("_h", F.xxhash64("_line"))


def segment(length: Column, i: Column, edits: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a string of that length."""
    start = F.floor(length * i / (edits + 1)).cast("int")
    return start, F.floor(length * (i + 1) / (edits + 1)).cast("int") - start


def _units(text: Column) -> Column:
    """The text in two bytes a character, so that a substring is found without reading what precedes it.

    Characters beyond two bytes count as one and the same: equal texts stay equal, so no partner is missed.
    """
    plain = F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.regexp_replace(text, "[\\x{10000}-\\x{10FFFF}]", "\uE000"))
    return F.encode(plain, "UTF-16BE")


def _key(group: Column, length: Column, i: Column, units: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(group, length, i, F.substring(units, 2 * start + 1, 2 * size))


def _index_rows(rows: DataFrame, group: Column, edits: Column, codes: Column) -> DataFrame:
    """``rows`` with ``_e`` and ``_x`` (k: key, s: start, z: size, longer): a row for each segment."""
    length = F.length("_line")
    coded = rows.withColumn("_u", _units(F.col("_line"))).withColumn("_c", F.explode(codes))
    start, size = segment(length, F.col("_c"), edits)
    key = _key(group, length, F.col("_c"), F.col("_u"), start, size)
    return coded.withColumns({"_e": edits, "_x": F.struct(
        key.alias("k"), start.alias("s"), size.alias("z"), F.lit(False).alias("longer"))}).drop("_c", "_u")


def probe_codes(edits: int) -> list[int]:
    """Substrings that may equal a segment of a partner no longer than the line, as (edits, d, i, shift) in one number.

    For a partner shorter by d, segment i starts at most i places off from the left and ``edits - i`` from the
    right: every other place would need too many edits on one side of it.
    """
    return [((edits * 32 + d) * 32 + i) * 64 + shift + 32 for d in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)]


def _probe_rows(rows: DataFrame, group: Column, codes: Column, lengths: Column | None = None) -> DataFrame:
    """``rows`` with ``_e`` and ``_x`` as in the index, a row for each place of ``codes`` inside the text.

    ``longer``: d is over 0.  ``own``: the place is the line's own segment.  ``lengths``, of the partner's length and ``_e``:
    which partners count.
    """
    length, code = F.length("_line"), F.col("_c")
    coded = rows.withColumn("_u", _units(F.col("_line"))).withColumn("_c", F.explode(codes)).withColumns({
        "_e": F.shiftright(code, 16), "_d": F.shiftright(code, 11).bitwiseAND(F.lit(31)),
        "_i": F.shiftright(code, 6).bitwiseAND(F.lit(31)), "_p": length - F.shiftright(code, 11).bitwiseAND(F.lit(31))})
    start, size = segment(F.col("_p"), F.col("_i"), F.col("_e"))
    place = start + code.bitwiseAND(F.lit(63)) - 32
    fits = (F.col("_p") >= 0) & (place >= 0) & (place + size <= length)
    coded = coded.filter(fits if lengths is None else fits & lengths)
    return coded.withColumn("_x", F.struct(
        _key(group, F.col("_p"), F.col("_i"), F.col("_u"), place, size).alias("k"), place.alias("s"), size.alias("z"),
        (F.col("_d") > 0).alias("longer"), ((F.col("_d") == 0) & (place == start)).alias("own"))).drop("_c", "_d", "_i", "_p", "_u")


def bands(max_edits: int | Sequence[tuple[int, int]]) -> list[tuple[int, int | None, int]]:
    """(least length, first length beyond or None, edits) of each band; a number is one band of all lengths."""
    steps = [(0, max_edits)] if isinstance(max_edits, int) else sorted(max_edits)
    return [(low, high, edits) for (low, edits), high in zip(steps, [low for low, _ in steps[1:]] + [None])]


def _in_band(length: Column, low: int, high: int | None) -> Column:
    return (length >= low) if high is None else (length >= low) & (length < high)


def _of_edits(values: Callable[[int], list[int]], every: list[int]) -> Column:
    """The array of the row's edits ``_e``: the text may be what is left of a longer one, so its length does not tell."""
    return reduce(lambda out, e: out.when(F.col("_e") == e, F.lit(values(e))), every[1:],
                  F.when(F.col("_e") == every[0], F.lit(values(every[0]))))


def _segments(edits: int) -> list[int]:
    return list(range(edits + 1))


def within_band(a: Column, b: Column, max_edits: int | Sequence[tuple[int, int]]) -> Column:
    """Whether the edit distance is within the band of ``b``, the shorter text."""
    out = F.lit(False)
    for low, high, edits in bands(max_edits):
        out = F.when(_in_band(F.length(b), low, high), within(a, b, edits)).otherwise(out)
    return out


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance is at most ``edits``, over the diagonal band alone.

    Lane e tells, by a bit for each of the ``2·edits + 1`` prefixes of ``a`` whose length differs from the part of ``b`` read
    by no more than ``edits``, which are within e edits.  One character of ``b`` updates all of them by a few
    bit operations; blocks of letters that cannot change them are passed over.
    """
    width = 2 * edits + 1
    last_state = _packed(edits) if edits <= MOST_PACKED else _by_lanes(edits)

    def letters(pair: Column) -> Column:
        def of(text: Column) -> Column:
            return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "", -1))
        # So many places before the first letter that no diagonal begins below 0.
        before = F.array_repeat(F.lit(None).cast("string"), edits)
        return F.struct(F.concat(before, of(pair["a"])).alias("a"), of(pair["b"]).alias("b"))

    gap = F.length(a) - F.length(b) + edits
    close = (gap >= 0) & (gap < width)
    # Bound once per pair, one after the other; named directly inside the step they would be made again for each letter.
    bound = F.transform(F.transform(_apart(a, b), letters), last_state)
    read = F.when(close, F.get(bound, F.lit(0)))
    return F.when(close, F.getbit(read, F.when(close, gap).otherwise(0)) == 1).otherwise(False)


def _packed(edits: int) -> Callable[[Column], Column]:
    """The last lane of a pair of letter arrays, at bit 0, all lanes being one number; ``MOST_PACKED`` edits at most.

    Lane e holds a bit for each prefix of ``a`` whose length differs from the part of ``b`` read by no more than e: set if
    that prefix is within e edits.  One letter of ``b`` updates all lanes together by a few bit operations.
    """
    width = 2 * edits + 1  # of a lane; that of e edits begins at bit width * e - edits
    least = width * edits - edits

    def number(value: int) -> Column:
        return F.lit(value).cast("bigint")

    lower, every = number((1 << least) - 1), number((1 << (least + width)) - 1)
    # One prefix and what further edits reach from it: a bit more to either side in each lane.
    cone = sum(1 << (width * e + k) for e in range(edits + 1) for k in range(-e, e + 1))
    # Diagonal k in all lanes (of the first, only the middle one counts).
    lanes = [sum(1 << p for e in range(edits + 1) if (p := width * e + k - edits) >= 0) for k in range(width)]

    def step(state: Column, equal: Column) -> Column:
        kept, reach = state.bitwiseAND(equal), 1
        while reach <= edits:  # letters of ``a`` left out, one lane up each
            kept = kept.bitwiseOR(F.shiftleft(kept, reach * (width + 1)))
            reach *= 2
        if not edits:
            return kept
        less = state.bitwiseAND(lower)
        return kept.bitwiseOR(F.shiftleft(less, width)).bitwiseOR(F.shiftleft(less, width - 1)).bitwiseAND(every)

    def last_state(pair: Column) -> Column:
        # Block by block: a whole block costs one look once the state is empty, or if one diagonal is ahead and the block
        # agrees along it: whatever further diagonals could be reached lies within its cone.
        def block(state: Column, turn: Column) -> Column:
            begin = turn * BLOCK
            first = F.bit_count(state.bitwiseAND(-state) - 1)
            settled = state == F.call_function("shiftleft", number(cone), first).bitwiseAND(every)
            read = F.slice(pair["b"], begin + 1, F.lit(BLOCK))
            same = F.slice(pair["a"], begin + (first + edits) % width + 1, F.lit(BLOCK)) == read

            def masks(near: Column) -> Column:
                return F.transform(read, lambda letter, i: reduce(lambda x, y: x.bitwiseOR(y), [
                    F.when(F.get(near, i + k) == letter, number(lanes[k])).otherwise(number(0)) for k in range(width)]))

            # The letters of ``a`` beside the block, bound once.
            beside = F.transform(F.array(F.slice(pair["a"], begin + 1, F.lit(BLOCK + 2 * edits))), masks)
            return F.when(state == 0, state).when(settled & same, state).otherwise(
                F.aggregate(F.get(beside, F.lit(0)), state, step))

        blocks = F.sequence(F.lit(0), F.floor((F.size(pair["b"]) - 1) / BLOCK).cast("int"))
        read = F.when(F.size(pair["b"]) == 0, number(cone)).otherwise(F.aggregate(blocks, number(cone), block))
        return F.shiftright(read, least)

    return last_state


def _by_lanes(edits: int) -> Callable[[Column], Column]:
    """The last state of a pair of letter arrays, each lane a number of its own: for more edits than one number holds."""
    width = 2 * edits + 1
    mask = (1 << width) - 1
    states = [f"r{e}" for e in range(edits + 1)]
    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits & mask).alias(s) for e, s in enumerate(states)])

    def last_state(pair: Column) -> Column:
        def step(state: Column, at: Column) -> Column:
            letter = F.get(pair["b"], at)
            same = [F.when(F.get(pair["a"], at + k) == letter, 1 << k).otherwise(0) for k in range(width)]
            equal = reduce(lambda x, y: x.bitwiseOR(y), same)
            new: list[Column] = []
            for e, s in enumerate(states):
                value = state[s].bitwiseAND(equal)
                if e:
                    old = state[states[e - 1]]
                    value = value.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1))
                new.append(value.bitwiseAND(F.lit(mask)))
            made = F.struct(*[v.alias(s) for v, s in zip(new, states)])
            return F.when(state[states[-1]] == 0, state).otherwise(made)

        def settled(state: Column) -> Column:
            """One diagonal is ahead: the first state that is not empty is that bit, each further one its reach by one more edit.

            Whatever further diagonals could be reached lies within that, so letters that agree along the one change nothing.
            """
            fits = [state[states[0]].bitwiseAND(state[states[0]] - 1) == 0]
            for less, more in zip(states, states[1:]):
                x = state[less]
                wider = x.bitwiseOR(F.shiftleft(x, 1)).bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(mask))
                fits.append(F.when(x == 0, state[more].bitwiseAND(state[more] - 1) == 0).otherwise(state[more] == wider))
            return reduce(lambda x, y: x & y, fits)

        # Block by block: a whole block costs one look once the last state is empty, or if it agrees along the one diagonal
        # that is ahead.
        def block(state: Column, number: Column) -> Column:
            begin = number * BLOCK
            ahead = F.coalesce(*[F.nullif(state[s], F.lit(0)) for s in states])
            same = F.slice(pair["a"], begin + F.bit_count(ahead - 1) + 1, F.lit(BLOCK)) == F.slice(
                pair["b"], begin + 1, F.lit(BLOCK))
            places = F.sequence(begin, F.least(begin + (BLOCK - 1), F.size(pair["b"]) - 1))
            return F.when(state[states[-1]] == 0, state).when(settled(state) & same, state).otherwise(
                F.aggregate(places, state, step))

        blocks = F.sequence(F.lit(0), F.floor((F.size(pair["b"]) - 1) / BLOCK).cast("int"))
        read = F.aggregate(blocks, start, block, lambda s: s[states[-1]])
        return F.when(F.size(pair["b"]) == 0, start[states[-1]]).otherwise(read)

    return last_state


def _apart(a: Column, b: Column) -> Column:
    """What two texts have between their common beginning and their common end, as an array of one struct (a, b).

    Edits lie there alone.  The common lengths are found bit by bit, comparing substrings.
    """
    powers = F.lit([1 << k for k in range(MOST_COMMON, -1, -1)])

    def common(pair: Column, room: Column, equal: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(powers, F.lit(0), lambda n, step: F.when(
            (n + step <= room) & equal(n, step), n + step).otherwise(n))

    def front(t: Column) -> Column:
        room = F.least(F.length(t["a"]), F.length(t["b"]))
        n = common(t, room, lambda n, step: F.substring(t["a"], n + 1, step) == F.substring(t["b"], n + 1, step))
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), n.alias("n"))

    def without_front(t: Column) -> Column:
        return F.struct(*[F.substring(t[c], t["n"] + 1, F.length(t[c]) - t["n"]).alias(c) for c in ("a", "b")])

    def back(t: Column) -> Column:
        room = F.least(F.length(t["a"]), F.length(t["b"]))

        def tail(c: str, n: Column, step: Column) -> Column:
            return F.substring(t[c], F.length(t[c]) - n - step + 1, step)
        n = common(t, room, lambda n, step: tail("a", n, step) == tail("b", n, step))
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), n.alias("n"))

    def without_back(t: Column) -> Column:
        return F.struct(*[F.substring(t[c], F.lit(1), F.length(t[c]) - t["n"]).alias(c) for c in ("a", "b")])

    out = F.array(F.struct(a.alias("a"), b.alias("b")))
    for part in (front, without_front, back, without_back):
        out = F.transform(out, part)
    return out


def _matching(pairs: DataFrame, texts: DataFrame, near: Column) -> DataFrame:
    """``_h`` of those pairs (_h, _lo) that are ``near``, a condition on the texts ``_a`` and ``_b``; each ``_h`` once."""
    own = texts.select("_h", F.col("_line").alias("_a"))
    partner = texts.select(F.col("_h").alias("_lo"), F.col("_line").alias("_b"))
    # Verifying costs far more than moving a pair: tasks of few pairs, whatever their bytes.
    tasks = max(1, -(-pairs.count() // PAIRS_OF_TASK))
    met = pairs.join(own, "_h").join(partner, "_lo")
    return met.repartition(tasks, F.xxhash64("_h", "_lo")).groupBy("_h").agg(F.bool_or(near).alias("_near")).filter("_near").select("_h")


def _packed_counts(text: Column) -> list[Column]:
    """Counts of the letters ``COUNTED`` modulo 8, four bits each, ``TO_A_NUMBER`` to a number."""
    def count(letter: str) -> Column:
        return (F.size(F.split(text, "\\." if letter == "." else letter, -1)) - 1).bitwiseAND(F.lit(7)).cast("bigint")
    return [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(count(c), 4 * i) for i, c in enumerate(COUNTED[at:at + TO_A_NUMBER])])
            for at in range(0, len(COUNTED), TO_A_NUMBER)]


def _of_each(bits: int) -> Column:
    """The four bits repeated for each letter of a number."""
    return F.lit(sum(bits << 4 * i for i in range(TO_A_NUMBER))).cast("bigint")


def _ring(counts: Column) -> Column:
    """Packed counts as places in a ring of eight: 0000, 0001, 0011, 0111, 1111, 1110, 1100, 1000.

    Neighbours differ in one bit, so two counts' places differ in no more bits than the counts differ.
    """
    low, mid, high = (F.shiftright(counts, k).bitwiseAND(_of_each(1)) for k in (0, 1, 2))
    ladder = low.bitwiseOR(mid).bitwiseOR(F.shiftleft(mid, 1)).bitwiseOR(F.shiftleft(low.bitwiseAND(mid), 2))
    return ladder.bitwiseXOR(reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(high, k) for k in range(4)]))


#: What lines are compared by: length and letter codes of the whole, then the step between cuts and the codes at the cuts.
WHOLE, CUT = ["n", "whole"], ["step", "cuts"]


def _whole_codes(text: Column) -> dict[str, Column]:
    """``n`` (length) and ``whole``: letter counts as places in rings."""
    return {"n": F.length(text), "whole": F.array(*[_ring(x) for x in _packed_counts(text)])}


def _cut_codes(text: Column) -> dict[str, Column]:
    """``step`` and ``cuts``: letter counts before and after each cut as places in rings, side by side.

    Lines are cut at the first ``CUTS`` multiples of a quarter of the largest power of two that their length reaches.
    """
    numbers = range(-(-len(COUNTED) // TO_A_NUMBER))
    power = F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.length(text).cast("bigint"))) - 1)
    step = F.greatest(F.lit(1), F.shiftright(power, 2))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(CUTS)), lambda j: F.substring(text, j * step + 1, step))
    counts = F.transform(blocks, lambda b: F.array(*_packed_counts(b)))
    none = F.array(*[F.lit(0).cast("bigint") for _ in numbers])

    def sums(c: Column) -> Column:
        def add(x: Column, y: Column) -> Column:
            return F.array(*[(F.get(x, F.lit(i)) + F.get(y, F.lit(i))).bitwiseAND(_of_each(7)) for i in numbers])
        return F.transform(F.sequence(F.lit(1), F.lit(CUTS + 1)), lambda j: F.aggregate(F.slice(c, F.lit(1), j), none, add))

    def codes(c: Column) -> Column:
        whole = F.get(c, F.lit(CUTS))
        return F.transform(F.slice(c, 1, CUTS), lambda x: F.array(*[_ring(F.get(x, F.lit(i))) for i in numbers], *[_ring(
            (F.get(whole, F.lit(i)).bitwiseOR(_of_each(8)) - F.get(x, F.lit(i))).bitwiseAND(_of_each(7))) for i in numbers]))
    # Bound one after the other; named directly inside the steps they would be made again for each cut.
    return {"step": step, "cuts": F.get(F.transform(F.transform(F.array(counts), sums), codes), F.lit(0))}


def _fit(a: Callable[[str], Column], b: Callable[[str], Column], max_edits: int | Sequence[tuple[int, int]], cuts: bool) -> Column:
    """Whether the letter codes of two lines leave an edit distance within the band of ``b``, the shorter text.

    An edit changes two counts by one at most, and one that changes the length only one count.  Before a cut, such an edit also moves one
    letter across the cut, and as many edits after it, less the difference of the lengths, move it back: what lies before and
    what lies after the cut differ by two counts an edit and that difference at most, both together.
    """
    allowed = F.lit(0)
    for low, high, edits in bands(max_edits):
        allowed = F.when(_in_band(b("n"), low, high), 2 * edits).otherwise(allowed)
    numbers = -(-len(COUNTED) // TO_A_NUMBER)

    def apart(x: Column, y: Column, n: int) -> Column:
        return reduce(lambda u, v: u + v, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(n)])
    gap = F.abs(a("n") - b("n"))
    fits = apart(a("whole"), b("whole"), numbers) + gap <= allowed
    if cuts:
        most = F.array_max(F.zip_with(a("cuts"), b("cuts"), lambda x, y: apart(x, y, 2 * numbers)))
        fits = fits & ((a("step") != b("step")) | (most <= allowed + gap))
    return fits


def _counts_allow(a: Column, b: Column, max_edits: int | Sequence[tuple[int, int]], cuts: bool = True) -> Column:
    """The same of two texts."""
    own, other = ({**_whole_codes(t), **_cut_codes(t)} for t in (a, b))
    return _fit(lambda c: own[c], lambda c: other[c], max_edits, cuts)


def _with_codes(rows: DataFrame, line: str, name: str, codes: DataFrame) -> DataFrame:
    return rows.join(codes.select(F.col("_h").alias(line), *[
        F.col(c).alias(f"{name}{c}") for c in WHOLE + CUT if c in codes.columns]), line)


def _fitting(max_edits: int | Sequence[tuple[int, int]], cuts: bool) -> Column:
    return _fit(lambda c: F.col(f"_a_{c}"), lambda c: F.col(f"_b_{c}"), max_edits, cuts)


def _allowed(rows: DataFrame, others: DataFrame, texts: DataFrame, max_edits: int | Sequence[tuple[int, int]]) -> DataFrame:
    """``_h, _lo`` of the ``rows`` (_g, _h, _longer) and the lines of ``others`` (_og, _lo) with their key whose letters allow it.

    ``_lo`` is before ``_h``; each pair once.  All is compared inside the join, before it yields a row, and a pair is made at the
    least of its keys alone: a key of many lines costs a few operations on numbers for each pair.
    """
    def keyed(side: DataFrame, line: str, key: str, keys: str) -> DataFrame:
        # A line has no more keys than places of ``probe_codes``.
        of_line = side.groupBy(line).agg(F.slice(F.sort_array(F.collect_set(key)), 1, FIRST_KEYS).alias(keys))
        return side.join(of_line, line)
    compared = rows.select("_h").unionByName(others.select(F.col("_lo").alias("_h"))).distinct()
    codes = staged(texts.join(compared, "_h", "left_semi").select("_h", *WHOLE, *[
        c.alias(name) for name, c in _cut_codes(F.col("_line")).items()]), "line-codes")
    left = _with_codes(keyed(rows, "_h", "_g", "_keys"), "_h", "_a_", codes)
    right = _with_codes(keyed(others, "_lo", "_og", "_okeys"), "_lo", "_b_", codes)
    once = F.coalesce(F.array_min(F.array_intersect("_keys", "_okeys")) == F.col("_g"), F.lit(True))
    fits = _fitting(max_edits, True)
    return left.join(right, (F.col("_g") == F.col("_og")) & _before() & fits & once).select("_h", "_lo").distinct()


def _allowed_pairs(pairs: DataFrame, texts: DataFrame, max_edits: int | Sequence[tuple[int, int]]) -> DataFrame:
    """Those of the pairs (_h, _lo) whose letters allow it, each once."""
    other = texts.select(F.col("_h").alias("_b_h"), *[F.col(c).alias(f"_b_{c}") for c in WHOLE])
    met = _with_codes(pairs.select("_h", "_lo").distinct(), "_h", "_a_", texts)
    return met.join(other, (F.col("_lo") == F.col("_b_h")) & _fitting(max_edits, False)).select("_h", "_lo")


def _before() -> Column:
    """Whether ``_lo`` is before ``_h`` in the order of (length, hash); ``_longer``: ``_h`` is the longer of the two."""
    return F.when(F.col("_longer"), F.col("_lo") != F.col("_h")).otherwise(F.col("_lo") < F.col("_h"))


def _indexed(lines: DataFrame, max_edits: int | Sequence[tuple[int, int]]) -> DataFrame:
    """Index rows of whole lines, by their band's edits."""
    edits = F.lit(0)
    for low, high, e in bands(max_edits):
        edits = F.when(_in_band(F.length("_line"), low, high), e).otherwise(edits)
    every = sorted({e for _, _, e in bands(max_edits)})
    return _index_rows(lines.withColumn("_e", edits), F.lit(0), F.col("_e"), _of_edits(_segments, every))


def _probing(lines: DataFrame, max_edits: int | Sequence[tuple[int, int]]) -> DataFrame:
    """Probes of whole lines for partners of every band in reach, by that band's edits."""
    length, parts, counts = F.length("_line"), [], F.lit(False)
    for low, high, e in bands(max_edits):
        reach = _in_band(length, low, None if high is None else high + e)
        parts.append(F.when(reach, F.lit(probe_codes(e))).otherwise(F.lit([0]).cast("array<int>")))
        counts = counts | ((F.col("_e") == e) & _in_band(F.col("_p"), low, high))
    return _probe_rows(lines, F.lit(0), F.concat(*parts), counts)


def _key_bits(heads: DataFrame) -> tuple[DataFrame, int]:
    """Bitmaps of the keys (``_all``) and of those with several lines (``_several``), in blocks of 64 words, and their bits."""
    bits = 1 << min(MOST_BITS, max(16, (KEY_BITS * heads.count()).bit_length()))
    placed = heads.select("_k", F.pmod("_k", F.lit(bits)).alias("_p"), (F.col("_lo") != F.col("_hi")).alias("_many")).select(
        F.shiftright("_p", 12).alias("_block"), F.expr("CAST(_p >> 6 & 63 AS INT)").alias("_word"), _key_mask().alias("_bit"), "_many")
    # Words first, which combine, an empty one for each place besides; then a block's 64 words side by side.
    empty = F.lit(0).cast("bigint")
    every = heads.sparkSession.range(bits >> 6).select(
        F.shiftright("id", 6).alias("_block"), F.col("id").bitwiseAND(F.lit(63)).cast("int").alias("_word"), empty.alias("_bit"), F.lit(False).alias("_many"))
    words = placed.unionByName(every).groupBy("_block", "_word").agg(
        F.bit_or("_bit").alias("all"), F.bit_or(F.when(F.col("_many"), F.col("_bit")).otherwise(empty)).alias("several"))
    found = words.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_word", "all", "several"))).alias("_words"))
    return found.select("_block", F.col("_words.all").alias("_all"), F.col("_words.several").alias("_several")), bits


def _key_mask() -> Column:
    """Three bits of a key's word, by parts of ``_k`` that the word's place does not use: of a key that is not there all are seldom set."""
    return F.expr(" | ".join(f"shiftleft(1L, CAST(_k >> {by} & 63 AS INT))" for by in (40, 46, 52)))


def _tested(probes: DataFrame, heads: DataFrame) -> DataFrame:
    """``_h, _k, _longer`` of the probes whose key may be in the index, of a line's own segments those that it may share.

    The bitmap's size is bounded, so it is broadcast; what meets nothing never reaches a shuffle.
    """
    blocks, bits = _key_bits(heads)
    blocks = F.broadcast(staged(blocks, "line-bits"))
    placed = probes.select("_h", F.col("_x.k").alias("_k"), F.col("_x.longer").alias("_longer"), F.col("_x.own").alias("_own")).withColumn(
        "_p", F.pmod("_k", F.lit(bits)))
    met = placed.join(blocks, F.shiftright("_p", 12) == F.col("_block"))
    word = F.expr("get(CASE WHEN _own THEN _several ELSE _all END, CAST(_p >> 6 & 63 AS INT))")
    return met.filter(word.bitwiseAND(_key_mask()) == _key_mask()).select("_h", "_k", "_longer")


def near_lines(
    docs: DataFrame, id_col: str, text_col: str, max_edits: int | Sequence[tuple[int, int]], min_chars: int,
) -> DataFrame:
    """``_h`` of lines with a near line before them, in the order of (length, hash): these go, the others stay.

    Each distinct line probes once, however many copies it has.  Probes are tested against a bitmap of the index keys in the
    same stage that makes them.  Narrow key rows (two numbers each) then meet in one join: the index is reduced to the
    first line of a key by a combinable aggregate, so no key holds more than one row there, and a hot line only
    lengthens the probing side, which Spark can split.  Lines whose key has a line before them are tested against that
    first one; most near lines are settled by it.  What is left meets all lines of its key if these are not too many; larger
    keys are split by the segments of what remains of their lines, as often as ``MOST_SPLITS``, before all are compared.
    Letter counts, made once per line, decide within the joins which pairs go on to the texts.
    """
    spark = docs.sparkSession
    since = staged_tables(spark)
    every = sorted({e for _, _, e in bands(max_edits)})
    near = within_band(F.col("_a"), F.col("_b"), max_edits)

    def matching(pairs: DataFrame) -> DataFrame:
        return staged(_matching(staged(pairs, "line-pairs"), texts, near), "line-settled")

    lines = staged(lines_of(docs, id_col, text_col, min_chars).groupBy("_h").agg(F.min("_line").alias("_line")), "line-distinct")
    index = _indexed(lines, max_edits).select("_h", F.col("_x.k").alias("_k"))
    first = staged(index.groupBy("_k").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi")), "line-heads")
    probes = _tested(_probing(lines, max_edits), first)
    matched = staged(probes.join(first, "_k").filter(_before()).distinct(), "line-matched")
    # All lines of the keys that matched, then the texts of all of them: a fraction of the lines.
    keys = staged(matched.filter("_lo <> _hi").select("_k").distinct(), "line-keys")
    members = staged(index.join(if_small(keys), "_k", "left_semi").distinct(), "line-members")
    wanted = staged(matched.select("_h").unionByName(matched.select(F.col("_lo").alias("_h"))).unionByName(
        members.select("_h")).distinct(), "line-wanted")
    texts = staged(lines.join(if_small(wanted), "_h", "left_semi").select("_h", "_line").withColumns(_whole_codes(F.col("_line"))), "line-texts")
    found = [matching(_allowed_pairs(matched, texts, max_edits))]
    # Open probes, and the index lines of their keys.
    left = staged(matched.filter("_lo <> _hi").join(found[0], "_h", "left_anti").select(
        F.col("_k").alias("_g"), "_h", "_longer").distinct(), "line-left")
    right = staged(members.join(left.select(F.col("_g").alias("_k")).distinct(), "_k", "left_semi").select(
        F.col("_k").alias("_g"), "_h"), "line-right")
    for turn in range(MOST_SPLITS + 1):
        sizes = staged(right.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "line-sizes")
        large = sizes.filter(F.lit(turn < MOST_SPLITS) & (F.col("_n") > SMALL_KEY)).select("_g")
        last = large.isEmpty()
        rows = left.join(sizes.select("_g"), "_g", "left_semi").join(large, "_g", "left_anti")
        found.append(matching(_allowed(rows.select("_g", "_h", "_longer"), right.select(F.col("_g").alias("_og"), F.col("_h").alias("_lo")), texts, max_edits)))
        if last:
            break
        if not turn:
            # With the text that is still to be compared.
            part = left.drop("_longer").join(large, "_g", "left_semi").join(texts.select("_h", "_line"), "_h")
            left = _probing(part, max_edits).filter("_x.k = _g").select(
                "_g", "_h", "_e", F.col("_x.longer").alias("_longer"), _rest("_line").alias("_line"))
            part = right.join(large, "_g", "left_semi").join(texts.select("_h", "_line"), "_h")
            right = _indexed(part, max_edits).filter("_x.k = _g").select("_g", "_h", "_e", _rest("_line").alias("_line"))
        part = _index_rows(right.join(large, "_g", "left_semi"), F.col("_g"), F.col("_e"), _of_edits(_segments, every))
        right = staged(part.select(F.col("_x.k").alias("_g"), "_h", "_e", _rest("_line").alias("_line")), "line-right")
        part = left.join(large, "_g", "left_semi").join(found[-1], "_h", "left_anti").select("_g", "_h", "_e", "_line")
        part = _probe_rows(part, F.col("_g"), _of_edits(probe_codes, every))
        part = part.select(F.col("_x.k").alias("_g"), "_h", "_e", F.col("_x.longer").alias("_longer"), _rest("_line").alias("_line"))
        heads = right.groupBy("_g").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        part = staged(part.join(heads, "_g").filter(_before()), "line-left")
        found.append(matching(_allowed_pairs(part, texts, max_edits)))
        left = staged(part.filter("_lo <> _hi").join(found[-1], "_h", "left_anti").drop("_lo", "_hi"), "line-left")
    return staged_alone(reduce(DataFrame.unionByName, found).distinct(), "line-near", since)


def _rest(text: str) -> Column:
    """What remains of the text without the substring that ``_x`` matched."""
    return F.concat(F.substring(text, F.lit(1), F.col("_x.s")), F.substring(text, F.col("_x.s") + F.col("_x.z") + 1, F.length(text)))


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int | Sequence[tuple[int, int]] = MAX_EDITS,
    min_chars: int = MIN_CHARS, copy_share: float | None = COPY_SHARE,
) -> DataFrame:
    """One row per id that has lines to drop: ``_id, exact, near, drop`` (arrays of line numbers, from 0).

    Of equal lines of at least ``min_chars`` characters the first stays, by id, then place.  Of lines within ``max_edits``
    (by the shorter line's length) the shortest stays, among equally short ones that with the smallest hash; all others go, which may
    reach along a chain of near lines.  A document that would lose over ``copy_share`` of the characters of its
    looked-at lines is a copy rather than a carrier of boilerplate: it is left whole, for the stages that
    compare documents, and has no row here; ``None`` switches this off.

    Null and empty texts have no lines; a null id counts as the last; rows that repeat an id are one document here: what
    goes from one goes from the other.  An empty table gives an empty table.
    """
    since = staged_tables(docs.sparkSession)
    lines = lines_of(docs, id_col, text_col, min_chars)
    places = lines.select("_h", F.hash("_line").alias("_m"), F.length("_line").alias("_size"), "_id", "_no").distinct()
    places = staged(places, "line-places")
    place = F.struct(F.col("_id").isNull().alias("o"), F.col("_id").alias("i"), F.col("_no").alias("n"))
    groups = places.groupBy("_h", "_m").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    near = near_lines(docs, id_col, text_col, max_edits, min_chars).withColumn("_near", F.lit(True))
    verdict = groups.join(near, "_h", "left").filter((F.col("_n") > 1) | F.col("_near"))
    judged = places.join(verdict, ["_h", "_m"]).withColumn(
        "_drop", F.coalesce("_near", F.lit(False)) | (place != F.col("_first"))).filter("_drop")
    lost = judged.groupBy("_id").agg(
        F.sum("_size").alias("_lost"),
        F.sort_array(F.collect_list(F.when(F.col("_near").isNull(), F.col("_no")))).alias("exact"),
        F.sort_array(F.collect_list(F.when(F.col("_near").isNotNull(), F.col("_no")))).alias("near"))
    if copy_share is not None:
        whole = places.groupBy("_id").agg(F.sum("_size").alias("_all"))
        lost = lost.alias("l").join(whole.alias("w"), F.col("l._id").eqNullSafe(F.col("w._id"))).filter(
            F.col("_lost") <= F.lit(copy_share) * F.col("_all")).select("l._id", "exact", "near")
    return staged_alone(lost.select("_id", "exact", "near", F.sort_array(F.concat("exact", "near")).alias("drop")), "line-lost", since)


def without_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken from their texts; all columns and all other rows as they were.

    The line numbers are broadcast while documents and lines to drop are few (counted), so that texts stay where they
    are; beyond that both sides are shuffled.
    """
    goes = staged(dropped.select(F.col("_id").alias("_dropped_id"), F.col("drop").alias("_dropped_lines")), "line-dropped")
    rows, lines = goes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_dropped_lines")), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and lines <= 4 * BROADCAST_ROWS:
        goes = F.broadcast(goes)
    # The row as one value: its columns cannot clash with those of the join.
    boxed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = boxed.join(goes, F.col("id").eqNullSafe(F.col("_dropped_id")), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("_dropped_lines", i))
    text = F.when(F.col("_dropped_lines").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    return met.select(F.col("doc").withField(text_col, text).alias("doc")).select("doc.*")
