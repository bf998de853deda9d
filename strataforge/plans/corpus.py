"""Training-data queries p1 to p5 over the repository tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions.normal import clean_path, counting_rows, element_key, fingerprint, key, rfc3339, utc_month
from strataforge.operators import compaction, hierarchy, keychunks, orphans, snapshots
from strataforge.session import cut, scratch_dir

BUSY_ROWS = 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- p1: a few keys hold most records ---------------------------------------


def busy_rows(refs: DataFrame, checks: DataFrame) -> DataFrame:
    """Both key fields as one relation: ``key_field, key_value, at, ref, fp``.

    ``fp`` only has to tell rows of one key, time and reference apart, so 64 bits do.
    """
    hashes = refs.select("branch", key(F.col("fileset_id")).alias("ref"), clean_path(F.col("path")).alias("path"), "seq", key(F.col("hash")).alias("key_value"), "size", "start_offset", F.col("recorded_at").alias("at"), "arrived_at")
    hashes = hashes.where(F.col("key_value").isNotNull())
    fp, _ = fingerprint(*[F.col(c) for c in ("branch", "path", "seq", "size", "start_offset", "arrived_at")])
    hashes = hashes.select(F.lit("hash").alias("key_field"), "key_value", "at", "ref", fp.alias("fp"))

    files = checks.select(key(F.col("hash")).alias("ref"), F.col("checked_at").alias("at"), F.explode("files").alias("f"))
    files = files.where(F.col("ref").isNotNull()).select("ref", "at", clean_path(F.col("f")).alias("key_value")).where(F.col("key_value") != "")
    fp, _ = fingerprint(F.col("ref"), F.col("at"))
    files = files.select(F.lit("file").alias("key_field"), "key_value", "at", "ref", fp.alias("fp"))
    return hashes.unionByName(files)


def key_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = busy_rows(table(spark, sf, "block_refs"), table(spark, sf, "block_checks"))
    return keychunks.key_states(rows, ["key_field", "key_value"], "at", "ref", ["fp"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Busy hashes and files with their first reference."""
    return key_summary(spark, sf).where(F.col("n_rows") >= BUSY_ROWS).select("key_field", "key_value", F.col("first_ref").alias("first_ref"))


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact number of different rows, first and last reference of every key."""
    return key_summary(spark, sf).select("key_field", "key_value", "n_rows", "first_ref", "last_ref")


def p1_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Longest time, in microseconds, between references to a key that follow each other."""
    return key_summary(spark, sf).where(F.col("longest_gap").isNotNull()).select("key_field", "key_value", "longest_gap")


# --- p2: what changed between full snapshots --------------------------------


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.changes(table(spark, sf, "filesets"))


def p2_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Number of changes per snapshot and kind."""
    return p2_found(spark, sf).groupBy("fileset_id", "change_kind").agg(F.count(F.lit(1)).alias("n_paths"))


# --- p3: references to records that do not exist ----------------------------


def references(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """Every reference once: ``ref_field, record_id, target_key, ref_month, ref_arrived``."""
    heads = counting_rows(commits.select(key(F.col("id")).alias("id"), "parents", "commit_time", "fileset_id", "arrived_at"), "id", ["parents", "commit_time", "fileset_id"])
    month = F.coalesce(utc_month(rfc3339(F.col("commit_time"))), F.lit("unknown"))
    parents = F.transform(F.coalesce("parents", F.array().cast("array<string>")), lambda p: F.struct(F.lit("commits.parents").alias("f"), element_key(p).alias("k")))
    both = F.array_distinct(F.concat(F.array(F.struct(F.lit("commits.fileset_id").alias("f"), key(F.col("fileset_id")).alias("k"))), parents))
    of_commits = heads.select("id", month.alias("ref_month"), "first_arrived", F.explode(both).alias("r")).select(F.col("r.f").alias("ref_field"), F.col("id").alias("record_id"), F.col("r.k").alias("target_key"), "ref_month", F.col("first_arrived").alias("ref_arrived"))
    of_refs = (
        refs.select(key(F.col("fileset_id")).alias("record_id"), key(F.col("hash")).alias("target_key"), "recorded_at", "arrived_at")
        .where(F.col("target_key").isNotNull())
        .groupBy("record_id", "target_key")
        .agg(F.min("recorded_at").alias("r"), F.min("arrived_at").alias("ref_arrived"))
        .select(F.lit("block_refs.hash").alias("ref_field"), "record_id", "target_key", F.coalesce(utc_month(F.col("r")), F.lit("unknown")).alias("ref_month"), "ref_arrived")
    )
    return of_commits.where(F.col("target_key").isNotNull()).unionByName(of_refs)


def raw_references(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """Field, key and period of raw rows, to find the heavy keys by counting."""
    of_refs = refs.select(F.lit("block_refs.hash").alias("ref_field"), key(F.col("hash")).alias("target_key"), utc_month(F.date_trunc("month", "recorded_at")).alias("ref_month"))
    month = F.substring("commit_time", 1, 7).alias("ref_month")
    of_sets = commits.select(F.lit("commits.fileset_id").alias("ref_field"), key(F.col("fileset_id")).alias("target_key"), month)
    of_parents = commits.select(F.lit("commits.parents").alias("ref_field"), F.explode("parents").alias("p"), month).select("ref_field", key(F.col("p")).alias("target_key"), "ref_month")
    return of_refs.unionByName(of_sets).unionByName(of_parents).where(F.col("target_key").isNotNull())


def reference_targets(commits: DataFrame, filesets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``ref_field, target_key, first_arrived, deleted_at`` of everything that exists."""

    def of(field: str, df: DataFrame, id_col: str) -> DataFrame:
        rows = df.select(key(F.col(id_col)).alias("target_key"), "arrived_at", "deleted_at")
        # deleted_at decides ties of the latest row; only its presence matters
        return counting_rows(rows, "target_key", ["deleted_at"]).withColumn("ref_field", F.lit(field))

    all_of = of("commits.fileset_id", filesets, "id").unionByName(of("commits.parents", commits, "id")).unionByName(of("block_refs.hash", blocks, "hash"))
    return all_of.select("ref_field", "target_key", "first_arrived", "deleted_at")


def _orphans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    commits, refs = table(spark, sf, "commits"), table(spark, sf, "block_refs")
    targets = reference_targets(commits, table(spark, sf, "filesets"), table(spark, sf, "blocks"))
    return references(commits, refs), targets, orphans.heavy_keys(raw_references(commits, refs))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.unresolved(*_orphans(spark, sf))


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per field, month and state."""
    return orphans.orphan_counts(*_orphans(spark, sf))


# --- p4: far too many small files -------------------------------------------


def consolidated(spark: SparkSession, sf: str) -> DataFrame:
    home = compaction.VersionedTable(spark, f"{scratch_dir(spark)}/consolidated-{uuid.uuid4().hex}")
    return compaction.compact(table(spark, sf, "loose_files"), home)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return consolidated(spark, sf).select("record_kind", "record_id")


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    """The consolidated records with their surviving copy."""
    return consolidated(spark, sf).select("record_kind", "record_id", "record", "file_name")


# --- p5: parent-child links to full hierarchies -----------------------------


def commit_links(commits: DataFrame) -> DataFrame:
    """``id, parent``: the first non-empty entry of ``parents`` of every commit."""
    heads = counting_rows(commits.select(key(F.col("id")).alias("id"), "parents", "arrived_at"), "id", ["parents"])
    filled = F.filter(F.transform(F.coalesce("parents", F.array().cast("array<string>")), element_key), lambda p: p.isNotNull())
    return heads.select("id", F.get(filled, 0).alias("parent"))


def commit_tree(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(commit_links(table(spark, sf, "commits")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return commit_tree(spark, sf).select("id", "root_id", "depth")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Number of descendants, and length of the path, of every commit outside circles."""
    return commit_tree(spark, sf).where(F.col("depth") >= 0).select("id", "n_descendants", (F.col("depth") + 1).alias("path_length"))


def p5_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Full path and all descendants of every commit, compressed.

    ``segments``: the path as chain pieces ``(head, upto)``; the descendants are the
    ids of the same root whose ``first`` lies after ``first`` and up to ``last``.
    Null for commits on or leading into circles.
    """
    return commit_tree(spark, sf).select("id", "root_id", "segments", "first", "last")


def p5_tip_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Full path of every branch tip outside circles, as ids from the root, one row per step.

    The tree is written before it is read twice.
    """
    tree = cut(commit_tree(spark, sf), "commit-tree")
    tips = table(spark, sf, "branches").select(key(F.col("tip")).alias("id")).where(F.col("id").isNotNull())
    return hierarchy.paths(tree, tips).select(F.col("id").alias("tip_id"), F.col("step").cast("bigint").alias("step"), F.col("node").alias("commit_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_gaps, p2_found, p2_summary, p3_found, p3_counts, p4_found, p4_records, p5_found, p5_descendants, p5_hierarchy, p5_tip_paths)}
