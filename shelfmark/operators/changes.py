"""Snapshots, changes between them, and the journal of changes.

An item has fields and state, both map<string, string>. A change is an upsert (fields and state), a
state patch (keys to new values, null for keys that went) or a remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EMPTY = "map<string,string>"


def _empty():
    return F.create_map().cast(EMPTY)


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """id, kind (upsert, state, remove) and payload of what differs between two tables (id, fields, state)."""
    p, c = previous.select("id", F.col("fields").alias("_f"), F.col("state").alias("_s")), current.select("id", "fields", "state")
    both = p.join(c, "id", "full_outer")
    entries = lambda m: F.array_sort(F.map_entries(F.coalesce(m, _empty())))
    same = lambda a, b: entries(a) == entries(b)
    changed = F.map_filter(F.map_zip_with(F.coalesce("_s", _empty()), F.coalesce("state", _empty()), lambda k, a, b: F.struct((~a.eqNullSafe(b)).alias("new"), b.alias("v"))), lambda k, v: v["new"])
    kind = (
        F.when(F.col("fields").isNull(), "remove")
        .when(F.col("_f").isNull() | ~same(F.col("_f"), F.col("fields")), "upsert")
        .when(~same(F.col("_s"), F.col("state")), "state")
    )
    payload = F.when(kind == "upsert", F.map_concat("fields", F.transform_keys(F.coalesce("state", _empty()), lambda k, v: F.concat(F.lit("state."), k)))).when(kind == "state", F.transform_values(changed, lambda k, v: v["v"])).otherwise(_empty())
    return both.select("id", kind.alias("kind"), payload.alias("payload")).where("kind is not null")


def collapse(changes: DataFrame, cursor: int) -> DataFrame:
    """What changed after a cursor, one row an item: revision (the last), kind, payload.

    The last upsert or remove replaces what was before it; state patches after it are laid over: into an
    upsert they merge, after a remove they stand alone. changes: revision, item_id, kind, payload.
    """
    after = changes.where(F.col("revision") > cursor)
    base = after.where("kind <> 'state'").groupBy("item_id").agg(F.max_by(F.struct("revision", "kind", "payload"), "revision").alias("base"))
    patches = after.where("kind = 'state'").select("item_id", "revision", F.explode_outer("payload").alias("k", "v"))
    joined = patches.join(base.select("item_id", F.col("base.revision").alias("_from")).hint("merge"), "item_id", "left").where(F.col("_from").isNull() | (F.col("revision") > F.col("_from")))
    # of every key the latest value: a partial aggregate, no list of an item's history
    last = joined.groupBy("item_id", "k").agg(F.max_by(F.struct("v"), "revision")["v"].alias("v"), F.max("revision").alias("r"))
    state = last.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("state"), F.max("r").alias("r"))
    out = base.join(state.hint("merge"), "item_id", "full_outer")
    kind = F.when(F.col("base").isNull() | (F.col("state").isNotNull() & (F.col("base.kind") == "remove")), "state").otherwise(F.col("base.kind"))
    over = F.map_filter(F.coalesce("base.payload", _empty()), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("state", _empty())), k))
    payload = F.when(F.col("base.kind") == "upsert", F.map_concat(over, F.coalesce("state", _empty()))).otherwise(F.coalesce("state", "base.payload", _empty()))
    return out.select("item_id", F.greatest("base.revision", "r").alias("revision"), kind.alias("kind"), payload.alias("payload"))


def apply_delta(current: DataFrame, delta: DataFrame) -> DataFrame:
    """A table (item_id, payload) after a collapsed delta: upserts replace, state patches lay over, removed items go."""
    d = delta.select("item_id", F.col("kind").alias("_kind"), F.col("payload").alias("_new"))
    both = current.join(d, "item_id", "full_outer")
    over = F.map_concat(F.map_filter(F.coalesce("payload", _empty()), lambda k, v: ~F.array_contains(F.map_keys("_new"), k)), F.col("_new"))
    payload = F.when(F.col("_kind") == "upsert", F.col("_new")).when(F.col("_kind") == "state", over).otherwise(F.col("payload"))
    # a patch of an unknown item is no item
    known = F.col("payload").isNotNull() | (F.col("_kind") == "upsert")
    return both.where((F.coalesce("_kind", F.lit("")) != "remove") & known).select("item_id", payload.alias("payload"))


def stable_merge(progress: DataFrame, columns: list[str]) -> DataFrame:
    """progress (item_id, run, revision, counters) where 0 or null repeats the last other value of the run."""
    w = Window.partitionBy("item_id", "run").orderBy("revision").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return progress.withColumns({c: F.coalesce(F.last(F.nullif(F.col(c), F.lit(0)), ignorenulls=True).over(w), F.col(c)) for c in columns})


def needs_full(cursors: DataFrame, journal: DataFrame) -> DataFrame:
    """cursor and whether it is too old for the journal, or beyond it."""
    low, high = journal.agg(F.min("revision")).scalar(), journal.agg(F.max("revision")).scalar()
    return cursors.select("cursor", (low.isNull() | (F.col("cursor") < low - 1) | (F.col("cursor") > high)).alias("needs_full"))


def removed(previous: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    return previous.select(key).distinct().join(current.select(key), key, "left_anti")
