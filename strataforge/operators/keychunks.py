"""Per-key results when a few keys hold most rows: exact offset chunking.

A plain ``groupBy(key)`` over rows that need numbering or ordering sends each key to
one task, so the largest key sets the running time. Here every key is laid out over
parts of about ``chunk_rows`` rows that follow each other in order:

1. repeated rows are combined, before and after a shuffle by their contents, so no
   group of copies, however large, meets in one task;
2. keys are counted per input partition (map side) and the counts added up; heavy
   keys get cuts of their order from a sample that is taken by row hash;
3. one shuffle brings every (key, part) to one task, which sorts and counts it;
4. the counts of the parts are prefix-summed to offsets, so rows are numbered exactly
   and in order: offset of the part + position inside the part;
5. chunks of equally many numbers give one small state each, with their ends;
6. the states of a key are merged in order, neighbours meeting at their ends.

Where the cuts lie only decides how even the parts are, never the result. There are
fewer than ``2 * MAX_PARTS`` parts of heavy keys at any size of the data, because
chunks grow with the rows of heavy keys; so what is broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strataforge.functions.normal import pack, unpack
from strataforge.session import cut, drop

#: Rows a part of a heavy key holds at least.
CHUNK_ROWS = 20_000
#: Parts of all heavy keys together stay below twice this: some MB of cuts.
MAX_PARTS = 50_000
#: Sampled rows per part that its cuts are taken from.
SAMPLE_ROWS = 16
#: Rows per shuffle partition aimed at, and the most partitions of the shuffle.
PARTITION_ROWS, MAX_PARTITIONS = 150_000, 50_000
#: Cuts are searched in two steps, through every so many-th first.
CUT_BLOCK = 128


def _here(order: list[str], identity: list[str]) -> Column:
    """Place of a row in the order of its key; nulls come last."""
    fields = [x for c in order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))]
    return F.struct(*fields, F.col(identity[0]).alias("tie"))


def _layout(rows: DataFrame, keys: list[str], order: list[str], identity: list[str], chunk_rows: int) -> tuple[DataFrame, int]:
    """(``keys``, ``_cuts``, ``_tops`` of the heavy keys; number of shuffle partitions)."""
    seen = Observation("keys")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).observe(seen, F.coalesce(F.sum("_size"), F.lit(0)).alias("rows"))
    large = cut(sizes.where(F.col("_size") > chunk_rows), "heavy-keys")
    in_large = large.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    part_rows = max(chunk_rows, -(-in_large // MAX_PARTS))
    heavy = large.where(F.col("_size") > part_rows)  # fewer than MAX_PARTS keys
    step = max(1, part_rows // SAMPLE_ROWS)
    sample = rows.where(F.pmod(F.xxhash64(*keys, *order, *identity), F.lit(step)) == 0).join(F.broadcast(heavy), keys)
    listed = sample.groupBy(*keys, F.ceil(F.col("_size") / part_rows).cast("int").alias("_parts")).agg(F.array_sort(F.collect_set(_here(order, identity))).alias("s"))
    every = lambda i: F.get("s", F.floor(i * F.size("s") / F.col("_parts")).cast("int"))
    cuts = listed.where(F.size("s") > 0).select(*keys, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), every)).alias("_cuts"))
    done = cut(cuts.select(*keys, "_cuts", F.filter("_cuts", lambda _, i: i % CUT_BLOCK == 0).alias("_tops")), "key-cuts")
    drop(large)
    return done, min(MAX_PARTITIONS, seen.get["rows"] // PARTITION_ROWS + 1)


def _part(here: Column) -> Column:
    """Number of cuts up to a row; 0 for keys without cuts."""
    upto = lambda cuts: F.size(F.filter(cuts, lambda c: c <= here))
    block = (upto(F.col("_tops")) - 1) * CUT_BLOCK
    few = F.size("_cuts") <= CUT_BLOCK
    return F.when(F.col("_cuts").isNull(), 0).when(few, upto(F.col("_cuts"))).when(block < 0, 0).otherwise(block + upto(F.slice("_cuts", F.greatest(block, F.lit(0)) + 1, F.lit(CUT_BLOCK))))


def _numbered(rows: DataFrame, keys: list[str], order: list[str], identity: list[str], chunk_rows: int) -> DataFrame:
    """:func:`number_rows` with ``_part`` and ``_before`` (``order[0]`` of the row before in the part)."""
    # plain IS NOT NULL per key: what joins on the keys infer anyway, so that all uses
    # of the shuffled rows have one and the same plan and the shuffle runs once
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    cuts, width = _layout(rows, keys, order, identity, chunk_rows)
    width = max(width, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = rows.distinct().drop(*identity[1:])
    spread = once.join(F.broadcast(cuts), keys, "left").withColumn("_part", _part(_here(order, identity)).cast("int")).withColumn("_heavy", F.col("_cuts").isNotNull()).drop("_cuts", "_tops")
    # half the bytes of hex ids, which no shuffle codec finds
    packed = [c for c, t in spread.dtypes if t == "string" and c not in keys]
    spread = spread.withColumns({c: pack(F.col(c)) for c in packed}).repartition(width, *keys, "_part").withColumns({c: unpack(F.col(c)) for c in packed})

    part = Window.partitionBy(*keys, "_part").orderBy(*[F.col(c).asc_nulls_last() for c in order], identity[0])
    local = spread.withColumn("_pos", F.row_number().over(part)).withColumn("_before", F.lag(order[0]).over(part))

    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        local.groupBy(*keys, "_part")
        .agg(F.max("_pos").alias("_n"), F.max("_heavy").alias("_split"))
        # on an aggregate, so that the filter stays above the shuffle of rows
        .where(F.col("_split"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n", "_split")
    )
    return (
        local.join(F.broadcast(offsets), [*keys, "_part"], "left")  # below 2 * MAX_PARTS rows
        # naming _heavy here keeps both uses of the shuffled rows alike, so it runs once
        .withColumn("row_no", F.when(F.col("_heavy"), F.col("_offset")).otherwise(F.lit(0).cast("bigint")) + F.col("_pos"))
        .withColumn("chunk_no", F.floor((F.col("row_no") - 1) / chunk_rows))
        .drop("_heavy", "_pos", "_offset")
    )


def number_rows(rows: DataFrame, keys: list[str], order: list[str], identity: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Different rows of ``rows``, each with its exact number inside its key.

    Adds ``row_no`` (1-based, without gaps per key, in the order of ``order``, nulls
    last, ties by ``identity[0]``) and ``chunk_no`` (``(row_no - 1) // chunk_rows``).
    ``identity``: columns that, with keys and order, tell rows apart, the first a number
    that spreads (a hash); all but the first are dropped. Repeated rows count once. A null in
    ``identity`` is a value like others. Rows with a null in a key column are left
    out. An empty table gives an empty result. Names of columns must not begin with
    ``_``, nor be ``row_no`` or ``chunk_no``.
    """
    return _numbered(rows, keys, order, identity, chunk_rows).drop("_part", "_before")


def key_states(rows: DataFrame, keys: list[str], order: str, ref: str, identity: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Count, first and last reference and longest gap of every key, exact under any skew.

    Returns ``keys``, ``n_rows`` (different rows), ``n_chunks``, ``first_ref`` and
    ``last_ref``: the ``ref`` of the row with the smallest / largest ``order``; on
    ties the smaller / larger ``ref``. A null ``order`` counts after all others for
    the first and before all others for the last. ``longest_gap``: the largest
    difference of ``order`` (a timestamp, in microseconds) between rows that follow
    each other; null with fewer than two.
    """
    numbered = _numbered(rows, keys, [order, ref], identity, chunk_rows)
    low = F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"), F.col(ref).isNull().alias("m"), F.col(ref).alias("r"))
    high = F.struct(F.col(order).alias("o"), F.col(ref).alias("r"))
    gap = F.unix_micros(F.col(order)) - F.unix_micros(F.col("_before"))
    states = numbered.groupBy(*keys, "_part", "chunk_no").agg(F.count(F.lit(1)).alias("n"), F.min(low).alias("lo"), F.max(high).alias("hi"), F.max(gap).alias("inside"))
    # the part before ends where this one begins; pieces inside a part have met already
    neighbour = Window.partitionBy(*keys).orderBy("_part", "chunk_no")
    met = states.withColumn("between", F.unix_micros(F.col("lo.o")) - F.unix_micros(F.lag("hi.o").over(neighbour)))
    return met.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.countDistinct("chunk_no").alias("n_chunks"),
        F.min("lo")["r"].alias("first_ref"),
        F.max("hi")["r"].alias("last_ref"),
        F.max(F.greatest("inside", "between")).alias("longest_gap"),
    )
