"""Block inventory, reuse statistics, integrity checks and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.strings import shorten


def explode_blocks(entries: DataFrame) -> DataFrame:
    """Entries with ``blocks array<struct<hash,size>>`` to one row per block."""
    keep = [c for c in entries.columns if c != "blocks"]
    return entries.select(*keep, F.posexplode("blocks").alias("seq", "b")).select(*keep, "seq", F.col("b.hash").alias("hash"), F.col("b.size").alias("size"))


def tip_sets(branches: DataFrame, commits: DataFrame) -> DataFrame:
    """``name, fileset_id`` of the branch tips.

    Branches without a tip, tips without a commit, commits without a snapshot
    are passed over.
    """
    tips = branches.where(F.col("tip").isNotNull()).join(commits.select(F.col("id").alias("tip"), "fileset_id"), "tip")
    return tips.where(F.col("fileset_id").isNotNull()).select("name", "fileset_id")


def tip_refs(sets: DataFrame, entries: DataFrame) -> DataFrame:
    """Block references of the snapshots of ``sets``: ``branch, path, seq, hash, size``."""
    return explode_blocks(entries.join(sets, "fileset_id").select(F.col("name").alias("branch"), "path", "blocks")).where(F.col("hash").isNotNull())


def inventory(refs: DataFrame) -> DataFrame:
    """Per hash: size, number and lists of paths and branches (sorted).

    For listings that show all files of a block: those of one hash form one row.
    Reports that need counts or the first file take :func:`inventory_report`.
    """
    return refs.groupBy("hash").agg(F.min("size").alias("size"), F.array_sort(F.collect_set("path")).alias("files"), F.array_sort(F.collect_set("branch")).alias("branches"))


def inventory_report(refs: DataFrame) -> DataFrame:
    """The inventory as text columns; of the files only the first, shortened in the middle.

    Files are counted, not listed: (hash, path) pairs are made first.
    """
    files = refs.groupBy("hash", "path").agg(F.min("size").alias("size")).groupBy("hash").agg(F.min("size").alias("size"), F.count("path").alias("n_files"), F.min("path").alias("first"))
    names = refs.groupBy("hash").agg(F.array_sort(F.collect_set("branch")).alias("branches"))
    return files.join(names, "hash").select("hash", "size", "n_files", shorten(F.col("first"), 40).alias("first_file"), F.array_join("branches", ",").alias("branches"))


def file_reuse_pct(summary: DataFrame) -> DataFrame:
    """Share of files that hold a shared block, in percent, from :func:`reuse_summary`; null without files."""
    return summary.select(F.round(F.col("files_with_shared") * 100.0 / F.nullif(F.col("total_files"), F.lit(0)), 6).alias("file_reuse_pct"))


def repair_totals(plan: DataFrame) -> DataFrame:
    """Bad blocks of a :func:`repair_plan`, and how many of them a source was found for."""
    return plan.agg(F.count(F.lit(1)).alias("n_bad"), F.count("path").alias("n_repairable"), F.count_if(F.col("path").isNull()).alias("n_lost"))


def inventory_listing(refs: DataFrame) -> DataFrame:
    """``hash, files, branches``: all of them joined, long lists shortened in the middle."""
    return inventory(refs).select("hash", *[shorten(F.array_join(c, ","), 70).alias(c) for c in ("files", "branches")])


def occurrences(refs: DataFrame) -> DataFrame:
    """Per hash: occurrences, different files and branches; counts only, no lists."""
    return refs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"), F.countDistinct("branch").alias("n_branches"))


def file_reuse(refs: DataFrame) -> DataFrame:
    """Per path, across branches: blocks, shared blocks (used more than once), ratio in percent.

    The join brings one number per block back to its references; keys used more
    than once are what is looked up, and Spark splits skewed ones.
    """
    many = refs.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("hash", F.lit(1).alias("shared"))
    marked = refs.select("hash", "path").groupBy("hash", "path").agg(F.count(F.lit(1)).alias("k")).join(many, "hash", "left")
    return marked.groupBy("path").agg(F.sum("k").alias("n_blocks"), F.sum(F.when(F.col("shared") == 1, F.col("k")).otherwise(0)).alias("n_shared")).withColumn("reuse_pct", F.col("n_shared") * 100.0 / F.col("n_blocks"))


def reuse_summary(refs: DataFrame, branches: DataFrame) -> DataFrame:
    """One row: totals, shared and unique blocks, average reuse. Null for 0/0."""
    blocks = refs.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("total_blocks"), F.count_if(F.col("n") > 1).alias("shared_blocks"))
    files = file_reuse(refs).agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("n_shared") > 0).alias("files_with_shared"), F.round(F.avg("reuse_pct"), 6).alias("avg_file_reuse"))
    total = branches.agg(F.count(F.lit(1)).alias("total_branches"))
    # three one-row results side by side
    return (
        blocks.crossJoin(files).crossJoin(total)
        .withColumn("unique_blocks", F.col("total_blocks") - F.col("shared_blocks"))
        .withColumn("overall_reuse", F.round(F.col("shared_blocks") * 100.0 / F.nullif(F.col("total_blocks"), F.lit(0)), 6))
    )


def shared_list(refs: DataFrame) -> DataFrame:
    """Blocks used more than once, most used first."""
    return occurrences(refs).where(F.col("n") > 1).orderBy(F.desc("n"), "hash")


def to_write(refs: DataFrame, store: DataFrame) -> DataFrame:
    """Referenced blocks the store lacks (by hash and size), each once."""
    wanted = refs.where(F.col("size").isNotNull()).groupBy("hash").agg(F.min("size").alias("size"))
    return wanted.join(store.select("hash", "size"), ["hash", "size"], "left_anti")


def verify(hashes: DataFrame, store: DataFrame, content_hash=F.md5) -> DataFrame:
    """``hash, status``: OK, Missing or Damaged (stored content hashes otherwise).

    ``store`` (``hash, content``) is hashed before the join, so contents are not
    shuffled.
    """
    checked = store.select("hash", F.coalesce(content_hash(F.col("content")) == F.col("hash"), F.lit(False)).alias("good"))
    status = F.when(F.col("good").isNull(), "Missing").when(F.col("good"), "OK").otherwise("Damaged")
    return hashes.select("hash").distinct().join(checked, "hash", "left").select("hash", status.alias("status"))


def first_bad(checks: DataFrame) -> DataFrame:
    """The first block that is not OK, by hash; no row if all are."""
    return checks.where(F.col("status") != "OK").orderBy("hash").limit(1)


def repair_plan(checks: DataFrame, sources: DataFrame) -> DataFrame:
    """For every bad block the source to rebuild it from: ``hash, status, path, seq``.

    ``sources``: blocks re-cut from files (``hash, path, seq``). The smallest
    path with the right hash wins; without one ``path`` is null (not repairable).
    """
    found = sources.groupBy("hash").agg(F.min(F.struct("path", "seq")).alias("s"))
    return checks.where(F.col("status") != "OK").join(found, "hash", "left").select("hash", "status", F.col("s.path").alias("path"), F.col("s.seq").alias("seq"))


def restore(entries: DataFrame, store: DataFrame) -> DataFrame:
    """Contents of files from ordered blocks: ``path, content, n_missing``.

    ``entries``: ``path, seq, hash``; ``store``: ``hash, content`` (strings).
    With a block missing the content is null.
    """
    joined = entries.join(store.select("hash", "content"), "hash", "left")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("c"))))
    return joined.groupBy("path").agg(parts.alias("p"), F.count_if(F.col("content").isNull()).alias("n_missing")).select("path", F.when(F.col("n_missing") == 0, F.array_join(F.transform("p", lambda x: x["c"]), "\n")).alias("content"), "n_missing")


def fileset_ids(entries: DataFrame, hash_of=F.md5) -> DataFrame:
    """Content hash of every fileset: hashes of all blocks in order of the path.

    Paths themselves do not count, nor does the order of the entries. The hashes of a
    fileset form one string, as the id demands; a row holds some ten million of them.
    """
    one = F.struct("path", F.transform("blocks", lambda b: F.coalesce(b["hash"], F.lit(""))).alias("h"))
    hashes = F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda e: e["h"]))
    text = F.array_join(F.transform(hashes, lambda h: F.concat(h, F.lit("\n"))), "")
    return entries.groupBy("fileset_id").agg(hash_of(text).alias("content_id"))
