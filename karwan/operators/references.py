"""References to records that do not exist: missing, deleted or created later than the reference.

Skew-aware split: references are aggregated per key and period before anything is shuffled by key;
keys with a large share of all references (there can be only a bounded number of them) are looked up
through a broadcast, all others through a shuffled join; both results are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if at least one in HEAVY_SHARE references names it: at most HEAVY_SHARE keys a field are broadcast.
HEAVY_SHARE = 500


@dataclass(frozen=True)
class Target:
    """A referred table: its rows, the field that refers to it and its name in the deletion log."""

    field: str
    rows: DataFrame
    entity: str
    id_col: str = "id"


def target_states(targets: list[Target], log: DataFrame) -> DataFrame:
    """One row a (field, key) that has a row or a log entry: has_row, deleted, born.

    deleted: there is no row, or the latest deleted_at is not before the latest updated_at of the rows
    (created_at where that is null; with neither any entry counts). born: the earliest created_at.
    Rows and entries with a null key are left out; entries with a null time count as deletions at an unknown time
    and only hold where there is no row or the rows have no time.
    """
    parts = None
    for t in targets:
        rows = t.rows.where(F.col(t.id_col).isNotNull()).groupBy(F.col(t.id_col).cast("long").alias("key")).agg(
            F.lit(True).alias("has_row"), F.coalesce(F.max("updated_at"), F.max("created_at")).alias("fresh"), F.min("created_at").alias("born"))
        gone = log.where((F.col("entity") == t.entity) & F.col("record_id").isNotNull()).groupBy(F.col("record_id").cast("long").alias("key")).agg(F.lit(True).alias("logged"), F.max("deleted_at").alias("gone_at"))
        one = rows.join(gone, "key", "full").select(
            F.lit(t.field).alias("field"), "key", F.coalesce("has_row", F.lit(False)).alias("has_row"),
            F.coalesce(F.col("logged") & (F.col("has_row").isNull() | F.col("fresh").isNull() | (F.col("gone_at") >= F.col("fresh"))), F.lit(False)).alias("deleted"), "born",
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


def references(links: DataFrame, fields: list[str], id_col: str = "id", time_col: str = "created_at") -> DataFrame:
    """(link_id, field, key, at, period) for every reference that is not null; period is the month of the link or null."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as bigint)" for f in fields)
    return links.select(F.col(id_col).alias("link_id"), F.col(time_col).alias("at"), F.expr(f"stack({len(fields)}, {pairs})").alias("field", "key")).where("key is not null").withColumn("period", F.date_trunc("month", "at"))


def _verdicts(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Unsound (field, key, period) groups: state, n, born, mixed (only some of the group's links are too early)."""
    groups = refs.groupBy("field", "key", "period").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    total = groups.groupBy("field").agg(F.sum("n").alias("total"))  # one row a field
    keys = groups.groupBy("field", "key").agg(F.sum("n").alias("n_key"))
    heavy = keys.join(F.broadcast(total), "field").where(F.col("n_key") * HEAVY_SHARE >= F.col("total")).select("field", "key", F.lit(True).alias("heavy"))
    groups = groups.join(F.broadcast(heavy), ["field", "key"], "left")
    heavy_states = states.join(F.broadcast(heavy.drop("heavy")), ["field", "key"], "left_semi")
    by_broadcast = groups.where("heavy").join(F.broadcast(heavy_states), ["field", "key"], "left")
    by_shuffle = groups.where("heavy is null").join(states.hint("merge"), ["field", "key"], "left")
    judged = by_broadcast.unionByName(by_shuffle)
    state = (
        F.when(~F.coalesce("has_row", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("born") > F.col("first"), "late")
    )
    return judged.select("field", "key", "period", "n", "heavy", "born", state.alias("state"), F.coalesce((state == "late") & (F.col("born") <= F.col("last")), F.lit(False)).alias("mixed")).where("state is not null")


def orphan_links(links: DataFrame, targets: list[Target], log: DataFrame) -> DataFrame:
    """(link_id, ref_field, ref_state) for every unsound reference; ref_state is missing, deleted or late.

    Null references are no case. A null time, of the link or of the row, is never late. Repeated link rows give
    repeated results. Extra columns of the inputs are ignored.
    """
    refs = references(links, [t.field for t in targets])
    bad = _verdicts(refs, target_states(targets, log)).select("field", "key", F.col("period").alias("v_period"), "heavy", "born", "state", "mixed")
    hot = bad.where("heavy").select("field", "key").distinct()
    tagged = refs.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["field", "key"], "left")
    same = F.col("period").eqNullSafe(F.col("v_period"))
    warm = tagged.where("hot").join(F.broadcast(bad.where("heavy")), ["field", "key"]).where(same)
    cold = tagged.where("hot is null").join(bad.where("heavy is null"), ["field", "key"]).where(same)
    found = warm.unionByName(cold)
    return found.where(~F.col("mixed") | (F.col("born") > F.col("at"))).select("link_id", F.col("field").alias("ref_field"), F.col("state").alias("ref_state"))


def orphan_counts(links: DataFrame, targets: list[Target], log: DataFrame) -> DataFrame:
    """(ref_field, month, ref_state, n_refs): unsound references per referred field and month of the link (null: unknown).

    Groups that are unsound as a whole are counted from the aggregates alone; only mixed groups are read link by link.
    """
    refs = references(links, [t.field for t in targets])
    bad = _verdicts(refs, target_states(targets, log))
    whole = bad.where(~F.col("mixed")).select("field", "period", "state", "n")
    mixed = bad.where("mixed").select("field", "key", "period", "born", "state")
    some = refs.join(mixed, ["field", "key", "period"]).where(F.col("born") > F.col("at")).select("field", "period", "state", F.lit(1).cast("long").alias("n"))
    return whole.unionByName(some).groupBy(F.col("field").alias("ref_field"), F.col("period").alias("month"), F.col("state").alias("ref_state")).agg(F.sum("n").alias("n_refs"))
