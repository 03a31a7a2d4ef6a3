"""Change feeds, caches and queues: incremental state as keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dirty_items(changes: DataFrame) -> DataFrame:
    """(item_id, changed_at, deleted): items to read again, with their latest change.

    item: the item itself; collection-item 'c-i': its member i; changes of
    collections touch no item. Null events are left out.
    """
    c = changes.where(F.col("event").isNotNull() & F.col("type").isin("item", "collection-item")).select("change_id", "event", "type", "changed_at", F.explode("ids").alias("id")).distinct()
    item = F.when(F.col("type") == "item", F.col("id")).otherwise(F.substring_index("id", "-", -1)).try_cast("bigint")
    gone = (F.col("event") == "delete") & (F.col("type") == "item")
    c = c.select(item.alias("item_id"), "changed_at", "change_id", gone.alias("gone")).where("item_id IS NOT NULL")
    latest = F.max_by("gone", F.struct("changed_at", "change_id"))
    return c.groupBy("item_id").agg(F.max("changed_at").alias("changed_at"), latest.alias("deleted"))


def snapshot(state: DataFrame, fresh: DataFrame, dirty: DataFrame, key: str = "item_id") -> DataFrame:
    """The next state: rows not dirty are kept, dirty ones are read again, deleted ones left out."""
    kept = state.join(dirty.select(key), key, "left_anti")
    again = fresh.join(dirty.where("NOT deleted").select(key), key, "left_semi")
    return kept.unionByName(again)


def fresh_entries(entries: DataFrame, key: list[str], at: str, days: int, now) -> DataFrame:
    """The latest entry of each key that has not expired at `now`."""
    latest = entries.groupBy(*key).agg(F.max(at).alias(at))
    return latest.where(F.col(at) + F.expr(f"INTERVAL {int(days)} DAYS") > now)


def queue_upsert(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """(key, times, status, added): a keyed queue after all events; the last event sets the status, the first the time of entry."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("times"), F.max_by(status, F.col(order)).alias("status"), F.min(order).alias("added"))


def retained(old: DataFrame, new: DataFrame, key: str, ok: str, value: str) -> DataFrame:
    """(key, value): the new value where its reading succeeded, else the old one; a failed refresh erases nothing."""
    o, n = old.select(key, F.col(value).alias("_old")), new.select(key, F.when(F.col(ok), F.col(value)).alias("_new"))
    return o.join(n, key, "full").select(key, F.coalesce("_new", "_old").alias(value))
