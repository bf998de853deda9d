"""What changed between consecutive full snapshots: ordinals and bitmaps.

Every path of a branch gets a persistent ordinal: the same number in all snapshots of
the branch, and, where the table made by :func:`ordinals` is kept and handed in again,
in all later calls. The high part of the ordinal is a bucket of paths, the low part
the number inside the bucket, so a snapshot is a set of compressed containers, one
per bucket. Of two consecutive snapshots ``cur AND NOT prev`` are the additions,
``prev AND NOT cur`` the removals, and on ``prev AND cur`` the ordinal-aligned vectors
of content fingerprints show the changes.

Before anything is shuffled an entry becomes its clean path and one fingerprint of its
blocks. One shuffle brings file lists to their snapshot's place in the branch, one
carries the entries, by (branch, bucket). Branches with many entries get more buckets,
long histories are cut into runs that overlap by one snapshot, so no group grows with
the largest branch; a snapshot without a path in a bucket needs no row there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.normal import clean_path, element_key, key

#: Entries aimed at per bucket of a branch, and snapshots per run.
BUCKET_ROWS = 50_000
RUN_SNAPSHOTS = 256
#: Up to this many members a container is a sorted array, above a bit set.
ARRAY_MAX = 4096

KINDS = np.array(["added", "removed", "changed"], dtype=object)


class Container:
    """Compressed set of ordinals: a sorted array when sparse, else packed bits."""

    __slots__ = ("bits", "members")

    def __init__(self, members: np.ndarray, universe: int) -> None:
        if len(members) <= ARRAY_MAX:
            self.members, self.bits = members, None
        else:
            flags = np.zeros(universe, dtype=bool)
            flags[members] = True
            self.members, self.bits = None, np.packbits(flags, bitorder="little")

    def ordinals(self) -> np.ndarray:
        if self.bits is None:
            return self.members
        return np.flatnonzero(np.unpackbits(self.bits, bitorder="little"))

    def and_not(self, other: Container) -> np.ndarray:
        """Ordinals in this container and not in ``other``."""
        if self.bits is not None and other.bits is not None:
            return np.flatnonzero(np.unpackbits(self.bits & ~other.bits, bitorder="little"))
        return np.setdiff1d(self.ordinals(), other.ordinals(), assume_unique=True)

    def both(self, other: Container) -> np.ndarray:
        if self.bits is not None and other.bits is not None:
            return np.flatnonzero(np.unpackbits(self.bits & other.bits, bitorder="little"))
        return np.intersect1d(self.ordinals(), other.ordinals(), assume_unique=True)


def _diff_group(number: np.ndarray, ordinal: np.ndarray, prints: np.ndarray, paths: np.ndarray, first: int, end: int) -> list[tuple[int, int, np.ndarray]]:
    """(later snapshot, kind, paths) of the changes inside one (branch, bucket, run).

    Rows come in order of the snapshots ``number``; a snapshot from ``first`` to
    ``end`` without rows has no path in the bucket.
    """
    universe = int(ordinal.max()) + 1
    names = np.empty(universe, dtype=object)
    names[ordinal] = paths
    vectors = [np.zeros(universe, "int64") for _ in range(2)]
    none = Container(np.zeros(0, "int64"), universe)
    out: list[tuple[int, int, np.ndarray]] = []

    def put(at: int, kind: int, found: np.ndarray) -> None:
        if len(found):
            out.append((at, kind, names[found]))

    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    previous, last = none, first
    for k, (a, b) in enumerate(zip(starts, np.r_[starts[1:], len(number)])):
        now, members, vector = int(number[a]), ordinal[a:b], vectors[k % 2]
        vector[members] = prints[a:b]
        current = Container(np.sort(members), universe)
        if now > last + 1:  # the snapshots between are empty here
            put(last + 1, 1, previous.ordinals())
            previous = none
        if now > first:
            put(now, 0, current.and_not(previous))
            put(now, 1, previous.and_not(current))
            common = current.both(previous)
            put(now, 2, common[vector[common] != vectors[1 - k % 2][common]])
        previous, last = current, now
    if last < end:
        put(last + 1, 1, previous.ordinals())
    return out


def _differ(run_snapshots: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Changes of all groups of a partition that is sorted by branch, bucket, run and snapshot."""
    columns = ["snap_no", "ordinal", "fp", "path"]

    def changes_of(key: tuple, n_snaps: int, pieces: list[list[np.ndarray]]) -> list[tuple]:
        first, end = max(1, key[2] * run_snapshots), min(n_snaps, (key[2] + 1) * run_snapshots)
        return [(key[0], *x) for x in _diff_group(*[np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*pieces)], first, end)]

    def frame(found: list[tuple]) -> pd.DataFrame:
        sizes = [len(x[3]) for x in found]
        repeat = lambda values: np.repeat(np.array(values, dtype=object), sizes)
        return pd.DataFrame({"branch": repeat([x[0] for x in found]), "snap_no": np.repeat(np.array([x[1] for x in found], dtype="int32"), sizes), "path": np.concatenate([x[3] for x in found]), "change_kind": repeat([KINDS[x[2]] for x in found])})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, n_snaps, pieces = None, 0, []
        for batch in batches:
            if not len(batch):
                continue
            found: list[tuple] = []
            keys = [batch[c].to_numpy() for c in ("branch", "bucket", "run")]
            values = [batch[c].to_numpy() for c in columns]
            starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
            for a, b in zip(starts, np.r_[starts[1:], len(batch)]):
                key = (keys[0][a], int(keys[1][a]), int(keys[2][a]))
                if key != current:
                    if pieces:
                        found += changes_of(current, n_snaps, pieces)
                    current, n_snaps, pieces = key, int(batch["n_snaps"].iat[a]), []
                pieces.append([v[a:b] for v in values])
            if found:
                yield frame(found)
        if pieces and (found := changes_of(current, n_snaps, pieces)):
            yield frame(found)

    return run


def _files() -> Column:
    """The entries of a delivery as ``path`` and ``fp``, a fingerprint of the (hash, size) list.

    Only contents of one path are compared, pair by pair, so 64 bits are plenty.
    """
    # nulls are given a value: the hash passes over them
    block = lambda b: F.struct(F.coalesce(element_key(b["hash"]), F.lit("\x01")).alias("h"), F.coalesce(b["size"], F.lit(-(1 << 63))).alias("s"))
    prints = lambda f: F.xxhash64(F.size(F.coalesce(f["blocks"], F.array())), F.transform(F.coalesce(f["blocks"], F.array()), block))
    return F.transform("files", lambda f: F.struct(F.coalesce(clean_path(f["path"]), F.lit("")).alias("path"), prints(f).alias("fp")))


def deliveries(filesets: DataFrame, *keep: str) -> DataFrame:
    """``fileset_id, branch, taken_at, at, n_files, tie, entries`` of every row, and ``keep``.

    ``tie`` tells deliveries of one id and time apart by their contents; those that
    differ in nothing but where they have nulls count as one.
    """
    tie = F.xxhash64(key(F.col("branch")), "taken_at", F.size("files"), "files")
    return filesets.select(*keep, key(F.col("id")).alias("fileset_id"), key(F.col("branch")).alias("branch"), "taken_at", F.col("arrived_at").alias("at"), F.coalesce(F.size("files"), F.lit(-1)).alias("n_files"), tie.alias("tie"), _files().alias("entries"))


def newest(filesets: DataFrame) -> DataFrame:
    """``fileset_id, at, tie, branch, taken_at, n_files`` of the row that counts; -1 files for null."""
    last = F.max(F.struct("at", "tie", "branch", "taken_at", "n_files"))
    return deliveries(filesets).where(F.col("fileset_id").isNotNull()).groupBy("fileset_id").agg(last.alias("d")).select("fileset_id", "d.*")


def delivered(filesets: DataFrame) -> DataFrame:
    """The snapshots that count: ``fileset_id, branch, at, tie, snap_no, n_snaps, n_buckets``.

    One row per fileset id, of its latest arrival; without ``files`` it was not
    delivered and is passed over. Snapshots without a branch or ``taken_at``
    belong to no sequence. Ties in ``taken_at`` are ordered by id. Only metadata
    moves here, the ``files`` stay where they are.
    """
    one = newest(filesets)
    one = one.where((F.col("n_files") >= 0) & F.col("branch").isNotNull() & F.col("taken_at").isNotNull())
    per_branch = Window.partitionBy("branch")
    return one.select(
        "fileset_id",
        "branch",
        "at",
        "tie",
        F.row_number().over(per_branch.orderBy("taken_at", "fileset_id")).alias("snap_no"),
        F.count(F.lit(1)).over(per_branch).cast("int").alias("n_snaps"),
        F.greatest(F.ceil(F.sum("n_files").over(per_branch) / BUCKET_ROWS), F.lit(1)).cast("int").alias("n_buckets"),
    )


def entries(filesets: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per entry of a counting snapshot: ``branch, snap_no, n_snaps, n_buckets, pos, path, fp``."""
    source = deliveries(filesets).where(F.col("n_files") > 0).select("fileset_id", "at", "tie", "entries")
    same = (F.col("s.fileset_id") == F.col("m.fileset_id")) & F.col("s.at").eqNullSafe(F.col("m.at")) & (F.col("s.tie") == F.col("m.tie"))
    # identical deliveries are one: any of them gives the same entries
    listed = meta.alias("m").join(source.alias("s"), same).select("m.branch", "m.snap_no", "m.n_snaps", "m.n_buckets", F.posexplode("s.entries").alias("pos", "e"))
    return listed.select("branch", "snap_no", "n_snaps", "n_buckets", "pos", "e.path", "e.fp").where(F.col("path") != "")


def _numbered(filesets: DataFrame, meta: DataFrame, known: DataFrame | None) -> DataFrame:
    """Entries, of a path listed twice the last, with ``bucket`` and ``ordinal``.

    Paths of ``known`` keep their ordinals, new ones follow after the highest of the bucket.
    """
    if known is not None:  # the buckets of a branch stay as they are
        fixed = known.groupBy("branch").agg(F.max("n_buckets").alias("fixed"))
        meta = meta.join(fixed, "branch", "left").withColumn("n_buckets", F.coalesce("fixed", "n_buckets")).drop("fixed")
    rows = entries(filesets, meta).withColumn("bucket", F.pmod(F.xxhash64("path"), F.col("n_buckets")).cast("int")).withColumn("old", F.lit(None).cast("int"))
    if known is not None:
        kept = known.select("branch", F.lit(0).alias("snap_no"), F.lit(0).alias("n_snaps"), "n_buckets", F.lit(0).alias("pos"), "path", F.lit(0).cast("bigint").alias("fp"), "bucket", F.col("ordinal").alias("old"))
        rows = rows.unionByName(kept)
    rows = rows.repartition("branch", "bucket")
    group = Window.partitionBy("branch", "bucket")
    listed = group.orderBy("path", "snap_no", F.col("pos").desc(), "fp")
    again = F.lag("path").over(listed).eqNullSafe(F.col("path")) & F.lag("snap_no").over(listed).eqNullSafe(F.col("snap_no"))
    rows = rows.withColumn("again", again).where(~F.col("again")).drop("again", "pos")
    if known is None:
        return rows.withColumn("ordinal", F.dense_rank().over(group.orderBy("path")) - 1)
    rows = rows.withColumn("old", F.max("old").over(Window.partitionBy("branch", "bucket", "path"))).withColumn("next", F.coalesce(F.max("old").over(group) + 1, F.lit(0)))
    fresh = F.dense_rank().over(group.orderBy(F.col("old").isNotNull(), "path")) - 1
    return rows.withColumn("ordinal", F.coalesce("old", F.col("next") + fresh)).drop("next").where(F.col("snap_no") >= 0)


def ordinals(filesets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The ordinals of all paths, to be kept: ``branch, n_buckets, bucket, path, ordinal``.

    With those of earlier calls as ``known`` they stay and new paths are added.
    """
    return _numbered(filesets, delivered(filesets), known).select("branch", "n_buckets", "bucket", "path", "ordinal").distinct()


def changes(filesets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Paths added, removed or changed between consecutive snapshots.

    ``filesets``: ``id, branch, taken_at, arrived_at, files``; other columns are
    ignored. ``known``: kept ordinals of :func:`ordinals`. Returns ``fileset_id`` (the
    later snapshot), ``path``, ``change_kind``. Null and empty ``blocks`` are equal,
    ``start_offset`` does not matter, a null or empty path names nothing. The first
    snapshot of a branch and an empty table give no rows; an empty ``files`` removes
    all.
    """
    meta = delivered(filesets)
    numbered = _numbered(filesets, meta, known).where(F.col("snap_no") > 0)
    run = F.floor((F.col("snap_no") - 1) / RUN_SNAPSHOTS).cast("int")
    starts_run = (F.pmod(F.col("snap_no"), F.lit(RUN_SNAPSHOTS)) == 0) & (F.col("snap_no") < F.col("n_snaps"))
    runs = numbered.withColumn("run", F.explode(F.when(starts_run, F.array(run, run + 1)).otherwise(F.array(run))))
    # the partitions are those of the numbering: no shuffle here
    found = (
        runs.select("branch", "bucket", "run", "snap_no", "n_snaps", "path", "ordinal", "fp")
        .sortWithinPartitions("branch", "bucket", "run", "snap_no")
        .mapInPandas(_differ(RUN_SNAPSHOTS), "branch string, snap_no int, path string, change_kind string")
    )
    return found.join(meta.select("branch", "snap_no", "fileset_id"), ["branch", "snap_no"]).select("fileset_id", "path", "change_kind")
