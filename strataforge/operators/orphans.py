"""References to records that are missing, deleted or arrived later.

Skew-aware split: references are pre-aggregated per key and period, the few
heavy keys are checked by a broadcast of their (bounded) target states, all
other keys by a shuffle join, and both results are put together. No key's
references meet in one task: heavy ones never leave their map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.session import cut

#: Keys with more references than this are heavy, and what part of all references a
#: heavy key must hold at least: so there are fewer than HEAVY_KEYS, at any size.
HEAVY_ROWS, HEAVY_KEYS = 10_000, 20_000


def heavy_keys(refs: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The heavy keys (``ref_field``, ``target_key``), fewer than HEAVY_KEYS.

    Counted per key and period first, so that partial sums are what is shuffled.
    Keys over ``heavy_rows`` are candidates; of them those over their references'
    HEAVY_KEYS-th part are taken, which can be no more than HEAVY_KEYS.
    """
    per_period = refs.groupBy("ref_field", "target_key", "ref_month").agg(F.count(F.lit(1)).alias("n"))
    found = cut(per_period.groupBy("ref_field", "target_key").agg(F.sum("n").alias("n")).where(F.col("n") > heavy_rows), "heavy-refs")
    least = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HEAVY_KEYS
    return found.where(F.col("n") > least).select("ref_field", "target_key")


def _state(refs: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("first_arrived").isNull() & F.col("known").isNull(), "missing")
        .when(F.col("deleted_at").isNotNull(), "deleted")
        .when(F.col("first_arrived") > F.col("ref_arrived"), "late")
    )
    return refs.withColumn("ref_state", state).where(F.col("ref_state").isNotNull())


OUT = ["ref_field", "record_id", "target_key", "ref_month", "ref_state"]


def _split(refs: DataFrame, targets: DataFrame, keys: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Unresolved references to heavy keys, found by broadcast, and to all others, by a join."""
    on = ["ref_field", "target_key"]
    refs = refs.where(F.col("target_key").isNotNull())
    keys = heavy_keys(refs) if keys is None else keys
    targets = targets.withColumn("known", F.lit(True))
    # below HEAVY_KEYS rows: every heavy key with the state of its target
    heavy = F.broadcast(keys.join(targets, on, "left").withColumn("heavy", F.lit(True)))
    marked = refs.join(heavy, on, "left")
    by_broadcast = _state(marked.where(F.col("heavy"))).select(*OUT)
    rest = marked.where(F.col("heavy").isNull()).drop("heavy", "known", "first_arrived", "deleted_at")
    return by_broadcast, _state(rest.join(targets, on, "left")).select(*OUT)


def unresolved(refs: DataFrame, targets: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """References of ``refs`` whose target is missing, deleted or late.

    ``refs``: ``ref_field, record_id, target_key, ref_month, ref_arrived``, one
    row per case. ``targets``: ``ref_field, target_key, first_arrived,
    deleted_at``, one row per key. ``keys``: heavy keys of :func:`heavy_keys`,
    found among ``refs`` if not given. Null keys refer to nothing. A target or reference without a known arrival is
    never late. Empty tables: no references give no rows, no targets make every
    reference ``missing``.
    """
    heavy, rest = _split(refs, targets, keys)
    return heavy.unionByName(rest)


def orphan_counts(refs: DataFrame, targets: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Unresolved references and their different targets per field, period and state.

    Heavy and other keys are counted apart, per key first, and the counts united; no
    key is in both.
    """
    by = ["ref_field", "ref_month", "ref_state"]
    counted = [side.groupBy(*by, "target_key").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")) for side in _split(refs, targets, keys)]
    return counted[0].unionByName(counted[1]).groupBy(*by).agg(F.sum("n").alias("n_refs"), F.sum("k").alias("n_targets"))
