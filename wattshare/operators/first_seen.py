"""First-seen state: who was seen first when, kept up to date by new days alone.

The state has a row per client and community: its earliest stamp there and the readings at that stamp.  A day's
panel needs the day's readings and the state; earlier readings are not scanned again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattshare.operators.panel import KEYS, build_panel

STATE = ["client_id", "community_code", "first_utc", "n_first"]


def state_of(readings: DataFrame) -> DataFrame:
    """``STATE`` of these readings alone.

    The earliest stamp is a combinable minimum, joined back on client, community and stamp, so that a client with very
    many readings is spread over its stamps; readings without client are nobody's first.
    """
    known = readings.filter(F.col("client_id").isNotNull())
    earliest = known.groupBy("client_id", "community_code").agg(F.min("datetime_utc").alias("first_utc"))
    at_first = known.groupBy("client_id", "community_code", F.col("datetime_utc").alias("first_utc")).agg(
        F.count(F.lit(1)).alias("n_first"))
    same = [at_first[c].eqNullSafe(earliest[c]) for c in ("client_id", "community_code", "first_utc")]
    return at_first.join(earliest, same, "left_semi").select(*STATE)


def merged_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """State after new readings, whose own state is ``new``; order does not matter, late days included.

    Disjoint sets of readings merge exactly: of two earliest stamps the earlier one stays with its count, equal ones add.
    """
    both = state.select(*STATE).unionByName(new.select(*STATE))
    # Two rows per key at most.
    rows = F.sort_array(F.collect_list(F.struct("first_utc", "n_first")))
    merged = both.groupBy("client_id", "community_code").agg(rows.alias("_r")).withColumn("first_utc", F.get("_r", F.lit(0))["first_utc"])
    tied = F.filter("_r", lambda r: r["first_utc"] == F.col("first_utc"))
    count = F.aggregate(tied, F.lit(0).cast("bigint"), lambda s, r: s + r["n_first"])
    return merged.select("client_id", "community_code", "first_utc", count.alias("n_first"))


def new_clients_of(state: DataFrame) -> DataFrame:
    """Readings per (community, slot) that are their client's first ever, from the state alone."""
    # A row per community of a client.
    overall = F.min("first_utc").over(Window.partitionBy("client_id"))
    return (
        state.withColumn("_overall", overall).filter(F.col("first_utc") == F.col("_overall"))
        .groupBy("community_code", F.col("first_utc").alias("datetime_utc")).agg(F.sum("n_first").alias("n_new_clients"))
    )


def panel_of_new_days(new_readings: DataFrame, state_after: DataFrame, unique_readings: bool = False) -> DataFrame:
    """Panel rows of the new readings' slots, equal to those of a panel over all readings so far.

    ``state_after`` includes the new readings.  New days must be whole: a slot's readings all come in one delivery.
    """
    panel = build_panel(new_readings, unique_readings)
    fresh = new_clients_of(state_after).withColumnRenamed("n_new_clients", "_new")
    same = [panel[k].eqNullSafe(fresh[k]) for k in KEYS]
    counted = panel.join(fresh, same, "left")
    columns = [F.coalesce("_new", F.lit(0)).cast("bigint").alias("n_new_clients") if c == "n_new_clients" else panel[c]
               for c in panel.columns]
    return counted.select(*columns)


def revised_slots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(community, slot) whose count of new clients a late delivery changed: rows of earlier days to write again."""
    old = new_clients_of(before).withColumnRenamed("n_new_clients", "n_before")
    now = new_clients_of(after).withColumnRenamed("n_new_clients", "n_after")
    both = old.join(now, KEYS, "full")
    return both.filter(~F.col("n_before").eqNullSafe(F.col("n_after"))).select(
        *KEYS, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
