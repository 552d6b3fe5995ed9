"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshare.llm.common import WORD, text_or_empty
from wattshare.session import staged

#: Documents of a source that share one running sum: what a single task of the ranking sorts.
BUCKET_ROWS = 20_000
#: Knots of every source's schedule.  Times run from 0 to 1; ``ramp`` tilts the weight around its mean.
RAMPS = (0.5, 0.0, -0.5)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), total_percent: int = 150, most: int = 2,
) -> DataFrame:
    """Targets for a table ``source, source_size``: adds ``rank, weight, target, capped``.

    Sources in order of code point, null last, get the weights in turn and share ``total_percent`` of all sizes in
    proportion.  A target stops at ``most`` times its source's size and the excess is shared again by weight until
    none is above: one aggregate of one row for each round.  Empty sources get 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = staged(ranked.withColumns({
        "weight": F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")),
        "cap": (F.col("source_size") * most).cast("double")}), "mix-sources")
    # share: words for each unit of weight; sources whose cap lies below it are full.
    share = 0.0
    while True:
        full = F.col("cap") <= F.lit(share) * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        next_share = (row["all"] * total_percent / 100 - (row["full"] or 0.0)) / row["open"]
        if next_share <= share:
            break
        share = next_share
    wanted = F.lit(share) * F.col("weight")
    return ranked.withColumns({"target": F.least("cap", wanted), "capped": F.col("cap") <= wanted}).drop("cap")


def schedule_position(done: Column, ramp: Column) -> Column:
    """The time t in [0, 1] at which a source has given the share ``done`` of its tokens.

    The weight schedule of a source is linear, w(t) = 1 + ramp·(1 − 2t), with mean 1; integrated,
    W(t) = (1 + ramp)·t − ramp·t².  This inverts W.
    """
    root = F.sqrt(F.greatest(F.lit(0.0), F.pow(1 + ramp, 2) - 4 * ramp * done))
    return F.when(ramp == 0, done).otherwise(2 * done / (1 + ramp + root))


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2), total_percent: int = 150, most: int = 2,
    ramps: Sequence[float] = RAMPS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, size, source_size, target, taken, copies, position,
    positions``.

    ``size`` counts words.  A source is read in the order of the md5 of its ids; as often as its target asks, from the
    start again after its end.  ``taken``: words of the row that the mix takes over all readings; the document that the
    target's end falls into is taken in part, so a source's words differ from its target by less than one.
    ``copies``: times that the row is begun.  ``position`` in [0, 1]: where in training its
    first reading starts, from the source's schedule.  ``positions``: the same for each time that the row is begun, so later
    readings of a source lie where its schedule puts them; sort by these (``in_training_order``).

    Running sums are nested: sums of buckets of about ``bucket_rows`` rows, then rows within a bucket.  The number of
    buckets follows the count of rows, so one hot source spreads over as many tasks as it needs.

    Null text or text without words has size 0, is taken 0 times and lies where it would have started; ids may be null
    or repeat: rows are ordered by id, then by size, and equal rows take either place.  An empty table
    gives an empty table.
    """
    size = F.regexp_count(text_or_empty(F.col(text_col)), F.lit(WORD)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_key"))
    rows = staged(rows, "mix-rows")
    buckets = max(1, -(-rows.count() // bucket_rows))
    # Eight hex digits as a number: buckets keep the order of the keys.
    place = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("long")
    rows = rows.withColumn("_bucket", place)
    sums = staged(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-buckets")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    targets = source_targets(
        sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, total_percent, most)
    ramp = F.element_at(F.array(*[F.lit(float(r)) for r in ramps]), (F.col("rank") % len(ramps) + 1).cast("int"))
    plan = staged(starts.alias("s").join(
        targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))
    ).select("s.source", "_bucket", "_start", "source_size", "target", ramp.alias("_ramp")), "mix-plan")
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    met = rows.withColumnRenamed("source", "_source").withColumn(
        "_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    met = met.alias("r").join(plan.alias("p"), F.col("r._source").eqNullSafe(F.col("p.source"))
                              & (F.col("r._bucket") == F.col("p._bucket")))
    at = F.col("_start") + F.col("_in")
    words = F.round("target").cast("long")
    # Reading k of the source covers [k·source_size, (k+1)·source_size) of its demand.
    def part(k: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), words - k * F.col("source_size") - at))

    taken = sum((part(k) for k in range(1, most)), part(0))
    copies = sum(((part(k) > 0).cast("int") for k in range(1, most)), (part(0) > 0).cast("int"))
    def start(k: int) -> Column:
        done = F.when(words > 0, F.least(F.lit(1.0), (at + k * F.col("source_size")) / words)).otherwise(1.0)
        return schedule_position(done, F.col("_ramp"))

    return met.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"),
        copies.alias("copies"), start(0).alias("position"),
        F.slice(F.array(*[start(k) for k in range(most)]), F.lit(1), copies).alias("positions"))


def with_ranks(mixed: DataFrame, id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``mixed`` with ``ranks``: the place of each reading of a row among all readings in training order, gapless from 0.

    Readings are range-sorted by position in buckets of [0, 1]; where a bucket begins is the sum of those before.
    Ties of position go by id, null first, then by reading; rows equal in all that take either place.
    """
    rows = staged(mixed.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    begun = rows.select("_row", F.col(id_col).alias("_id"), F.posexplode("positions").alias("_reading", "_position"))
    buckets = max(1, -(-rows.agg(F.sum("copies")).first()[0] // bucket_rows)) if not rows.isEmpty() else 1
    placed = begun.withColumn("_bucket", F.floor(F.col("_position") * buckets))
    # A row per bucket.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    order = Window.partitionBy("_bucket").orderBy("_position", "_id", "_reading")
    ranked = placed.withColumn("_place", F.row_number().over(order) - 1).join(begins, "_bucket").select(
        "_row", F.struct("_reading", (F.col("_begin") + F.col("_place")).cast("long").alias("rank")).alias("_r"))
    # No more than the times a row is read.
    ranks = ranked.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list("_r")), lambda r: r["rank"]).alias("ranks"))
    empty = F.array().cast("array<bigint>")
    return rows.join(ranks, "_row", "left").select(*mixed.columns, F.coalesce("ranks", empty).alias("ranks"))


def in_training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows the mix takes, each as often as begun: ``reading`` from 1, ``position`` of that reading, range-sorted by it."""
    begun = mixed.select(*[c for c in mixed.columns if c not in ("position", "positions")],
                         F.posexplode("positions").alias("reading", "position"))
    return begun.withColumn("reading", F.col("reading") + 1).orderBy("position", id_col, "reading")
