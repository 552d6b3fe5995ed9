"""From client readings to one series per community."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshare.functions.moments import mean_of, merged, moments, std_of
from wattshare.functions.rowwise import flag, ratio
from wattshare.session import staged

KEYS = ["community_code", "datetime_utc"]

# Community of a client modelled alone is this prefix and the client id.
PROMOTED_PREFIX = "BIG_"


def _clients_in_unique_rows(n_rows: str) -> Column:
    """Clients behind ``n_rows`` readings of a slot, one per client and original community.

    A promoted client may read in several communities at once and still is one client.
    """
    promoted = F.col("community_code").startswith(PROMOTED_PREFIX)
    return F.when(promoted, F.least(n_rows, F.lit(1).cast("bigint"))).otherwise(F.col(n_rows))


def first_seen(readings: DataFrame) -> DataFrame:
    """First stamp of every client."""
    return readings.groupBy("client_id").agg(F.min("datetime_utc").alias("first_utc"))


def client_slots(readings: DataFrame) -> DataFrame:
    """Readings per (community, slot, client): one row each where the source is clean."""
    return (
        readings.filter(F.col("client_id").isNotNull())
        .groupBy(*KEYS, "client_id").agg(F.count(F.lit(1)).alias("n_rows"))
    )


def duplicate_readings(readings: DataFrame) -> DataFrame:
    """Client slots read more than once; empty means ``unique_readings=True`` is safe."""
    return client_slots(readings).filter(F.col("n_rows") > 1)


def new_clients(readings: DataFrame) -> DataFrame:
    """Readings per (community, slot) that are their client's first ever, where a client reads once per community and slot.

    The readings themselves are never joined or windowed per client: the earliest stamp of each
    (client, community) is a combinable aggregate, and only that small table is compared
    across communities.  A client holding a third of all readings costs nothing extra.
    """
    earliest = readings.groupBy("client_id", "community_code").agg(F.min("datetime_utc").alias("datetime_utc"))
    # At most one row per community in a client's window, whatever its number of readings.
    overall = F.min("datetime_utc").over(Window.partitionBy("client_id"))
    return (
        earliest.withColumn("first_utc", overall)
        .filter(F.col("datetime_utc") == F.col("first_utc"))
        .groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_new_clients"))
    )


# Clients of a block, one bit each in eight 64-bit words.
BLOCK_CLIENTS, WORDS = 512, 8
#: Clients up to which their numbers are broadcast to the readings; beyond, Spark sizes the join.
NUMBERED_ROWS = 500_000
#: Clients numbered by one task.
NUMBERED_TOGETHER = 50_000


def client_numbers(readings: DataFrame, together: int = NUMBERED_TOGETHER) -> DataFrame:
    """``client_id, first_utc, _number``: dense numbers from 0, clients of one home community side by side; stored.

    One combinable aggregation over the readings; the numbers are places within parts of a community plus the
    sums of the parts before, so no task sees all clients.  Home is the least community a client reads in: its clients
    then share few blocks.
    """
    clients = staged(readings.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.coalesce(F.min("community_code"), F.lit("")).alias("_home"), F.min("datetime_utc").alias("first_utc")), "clients")
    parts = clients.count() // together + 1
    parted = clients.withColumn("_part", F.pmod(F.xxhash64("client_id"), F.lit(parts)))
    # A row per community and part.
    before = Window.orderBy("_home", "_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parted.groupBy("_home", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_home", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_home", "_part").orderBy("client_id")) - 1
    return staged(parted.withColumn("_place", place).join(begins, ["_home", "_part"]).select(
        "client_id", "first_utc", (F.col("_begin") + F.col("_place")).alias("_number")), "client-numbers")


def _bits() -> list[Column]:
    """Aggregates: the bits of a block's clients, word by word."""
    word = F.expr(f"CAST(_number % {BLOCK_CLIENTS} DIV 64 AS INT)")
    bit = F.expr("shiftleft(1L, CAST(_number % 64 AS INT))")
    return [F.bit_or(F.when(word == w, bit)).alias(f"_w{w}") for w in range(WORDS)]


def client_blocks(readings: DataFrame, numbers: DataFrame, by: list[str], *stats: Column) -> DataFrame:
    """A row per key and block of clients: a bit for each client that reads there, and ``stats``.

    Bits combine by OR within tasks, before the shuffle and after it; a client seen many times costs nothing.  Readings
    without client are counted in the block NULL.
    """
    few = numbers.count() <= NUMBERED_ROWS
    numbered = readings.join(F.broadcast(numbers) if few else numbers, "client_id", "left")
    block = F.expr(f"_number DIV {BLOCK_CLIENTS}").alias("_block")
    return numbered.groupBy(*by, block).agg(*_bits(), *stats)


def _clients_in_blocks() -> Column:
    return F.sum(sum((F.bit_count(F.coalesce(f"_w{w}", F.lit(0).cast("bigint"))) for w in range(WORDS)), F.lit(0))).cast("bigint")


def distinct_clients(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Exact distinct clients per ``by``, columns of ``blocks``: per day or community from blocks per slot."""
    wider = blocks.groupBy(*by, "_block").agg(*[F.bit_or(f"_w{w}").alias(f"_w{w}") for w in range(WORDS)])
    return wider.groupBy(*by).agg(_clients_in_blocks().alias("n_clients"))


def _panel_from_blocks(readings: DataFrame, median_accuracy: int, numbers: DataFrame | None = None) -> DataFrame:
    """The panel of readings that may repeat: clients by bits, everything else merged from the blocks."""
    numbers = client_numbers(readings) if numbers is None else numbers
    kw = F.col("active_kw").cast("double")
    blocks = client_blocks(
        readings, numbers, KEYS, F.min("datetime_local").alias("_local"), F.count_if(kw.isNull()).alias("_missing"),
        F.count_if(F.col("datetime_utc") == F.col("first_utc")).alias("_new"), F.sum("active_kw").alias("_total"),
        moments("active_kw").alias("_moments"), F.min("active_kw").alias("_min"), F.max("active_kw").alias("_max"),
        F.kll_sketch_agg_double(kw, F.lit(median_accuracy)).alias("_sketch"))
    slots = blocks.groupBy(*KEYS).agg(
        F.min("_local").alias("datetime_local"), _clients_in_blocks().alias("n_clients"), F.sum("_missing").alias("n_missing"),
        F.sum("_new").alias("n_new_clients"), F.sum("_total").alias("total_kw"),
        # A block per 512 clients of the community.
        merged(F.collect_list("_moments")).alias("_m"), F.min("_min").alias("min_kw"), F.max("_max").alias("max_kw"),
        F.kll_merge_agg_double("_sketch", F.lit(median_accuracy)).alias("_sketch"))
    m = F.col("_m")
    median = F.when(m["n"] > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(0.5)))
    return slots.withColumns({"mean_kw": mean_of(m), "std_kw": std_of(m), "median_kw": median})


def build_panel(readings: DataFrame, unique_readings: bool = False, median_accuracy: int = 10_000) -> DataFrame:
    """Aggregate readings to one row per (community, UTC slot).

    Null readings are counted, never imputed.  All slot statistics combine map-side.  A source known to hold
    one reading per client, community and slot (``unique_readings``) counts rows; otherwise distinct clients
    are counted exactly by bits over dense client numbers, in the same pass as the statistics.
    """
    if unique_readings:
        stats = readings.groupBy(*KEYS).agg(
            F.min("datetime_local").alias("datetime_local"),
            F.count("client_id").alias("n_rows"),
            F.count_if(F.col("active_kw").isNull()).alias("n_missing"),
            F.sum("active_kw").alias("total_kw"),
            F.avg("active_kw").alias("mean_kw"),
            F.percentile_approx("active_kw", 0.5, median_accuracy).alias("median_kw"),
            F.stddev_samp("active_kw").alias("std_kw"),
            F.min("active_kw").alias("min_kw"),
            F.max("active_kw").alias("max_kw"),
        ).withColumn("n_clients", _clients_in_unique_rows("n_rows"))
        joined = stats.join(new_clients(readings), KEYS, "left")
    else:
        joined = _panel_from_blocks(readings, median_accuracy)
    return _panel_columns(joined)


def _panel_columns(joined: DataFrame) -> DataFrame:
    reporting = F.col("n_clients") - F.col("n_missing")
    return joined.select(
        *KEYS, "datetime_local", "n_clients", "n_missing",
        F.coalesce("n_new_clients", F.lit(0)).alias("n_new_clients"),
        "total_kw", "mean_kw", "median_kw", "std_kw", "min_kw", "max_kw",
        reporting.alias("n_reporting"),
        ratio("total_kw", "n_clients").alias("avg_kw_per_client"),
        ratio(F.col("total_kw"), reporting).alias("avg_kw_reporting"),
    )


def build_panel_min(readings: DataFrame, unique_readings: bool = False) -> DataFrame:
    """Only what the share needs: local stamp, total and client count."""
    if unique_readings:
        stats = readings.groupBy(*KEYS).agg(
            F.min("datetime_local").alias("datetime_local"),
            F.sum("active_kw").alias("total_kw"),
            F.count("client_id").alias("n_rows"),
        )
        return stats.withColumn("n_clients", _clients_in_unique_rows("n_rows")).drop("n_rows")
    blocks = client_blocks(
        readings, client_numbers(readings), KEYS, F.min("datetime_local").alias("_local"), F.sum("active_kw").alias("_total"))
    return blocks.groupBy(*KEYS).agg(
        F.min("_local").alias("datetime_local"), F.sum("_total").alias("total_kw"), _clients_in_blocks().alias("n_clients"))


def client_energy(readings: DataFrame, by: tuple[str, ...] = ("client_id",)) -> DataFrame:
    return readings.groupBy(*by).agg(F.sum("active_kw").alias("total_kw"))


def top_clients(readings: DataFrame, top_n: int = 30, fit_until: str | None = None) -> DataFrame:
    """The ``top_n`` clients by energy, ranked over readings before ``fit_until`` only.

    Ranked by client alone, so nobody is listed twice; ties go to the smaller id.
    """
    if top_n < 1:
        raise ValueError("top_n must be positive")
    if fit_until is not None:
        readings = readings.filter(F.col("datetime_local") < F.lit(fit_until).cast("timestamp_ntz"))
    return client_energy(readings).orderBy(F.desc_nulls_last("total_kw"), "client_id").limit(top_n)


BROADCAST_ROWS = 10_000


def reclassify_large_clients(readings: DataFrame, top_n: int = 30, fit_until: str | None = None) -> DataFrame:
    """Give each of the largest clients a community of its own, ``BIG_<client_id>``."""
    promoted = top_clients(readings, top_n, fit_until).select(
        "client_id", F.concat(F.lit(PROMOTED_PREFIX), F.col("client_id")).alias("_own"))
    # At most top_n rows by construction, so the hint is bounded; beyond that Spark sizes the join.
    if top_n <= BROADCAST_ROWS:
        promoted = F.broadcast(promoted)
    columns = [c for c in readings.columns if c != "community_code"]
    return readings.join(promoted, "client_id", "left").select(
        *columns, F.coalesce("_own", "community_code").alias("community_code"))


def with_new_flag(readings: DataFrame) -> DataFrame:
    """Row-level flags: first reading of its client, reading missing.

    Matched on client and stamp together, so a client with very many readings is spread over its stamps.
    """
    firsts = first_seen(readings).select("client_id", F.col("first_utc").alias("datetime_utc"), F.lit(1).alias("_first"))
    return readings.join(firsts, ["client_id", "datetime_utc"], "left").select(
        *readings.columns,
        flag(F.col("_first").isNotNull()).alias("is_new"),
        flag(F.col("active_kw").isNull()).alias("is_missing"),
    )


def null_rate(panel: DataFrame) -> DataFrame:
    """Share of null readings per community, in percent, worst first."""
    sums = panel.groupBy("community_code").agg(
        F.sum("n_missing").alias("total_null_readings"), F.sum("n_reporting").alias("total_reporting"))
    known = F.col("total_null_readings") + F.col("total_reporting")
    return sums.withColumn("null_pct", ratio(100 * F.col("total_null_readings"), known)).orderBy(
        F.desc("null_pct"), "community_code")
