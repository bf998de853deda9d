"""The repository tables as the relations the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataforge.functions.normal import clean_path, counting_rows, element_key, key, rfc3339
from strataforge.operators import blocks, snapshots


class Repository:
    """Views of one directory of tables."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def commits(self) -> DataFrame:
        """``id, parents, branch, message, ts, fileset_id``; of each id its latest row."""
        rows = self.table("commits").select(key(F.col("id")).alias("id"), "parents", "branch", "message", "commit_time", "fileset_id", "arrived_at")
        one = counting_rows(rows, "id", ["parents", "branch", "message", "commit_time", "fileset_id"])
        return one.select("id", F.transform(F.coalesce("parents", F.array().cast("array<string>")), element_key).alias("parents"), key(F.col("branch")).alias("branch"), "message", rfc3339(F.col("commit_time")).alias("ts"), key(F.col("fileset_id")).alias("fileset_id"))

    def branches(self) -> DataFrame:
        """``name, tip``: the latest pointer of every branch."""
        rows = self.table("branches").select(key(F.col("name")).alias("name"), key(F.col("tip")).alias("tip"), "updated_at").where(F.col("name").isNotNull())
        return rows.groupBy("name").agg(F.max(F.struct("updated_at", "tip"))["tip"].alias("tip"))

    def snapshots(self) -> DataFrame:
        """``fileset_id, branch, taken_at`` of each delivered fileset; its ``at`` and ``tie`` find the row."""
        return snapshots.newest(self.table("filesets")).where(F.col("n_files") >= 0).select("fileset_id", "branch", "taken_at", "at", "tie")

    def entries(self, of: DataFrame | None = None) -> DataFrame:
        """``fileset_id, branch, taken_at, path, blocks``; the last entry of a path counts.

        Only of the filesets in ``of`` (``fileset_id``), if given: they are chosen by
        their metadata, before any file list is read apart.
        """
        heads = self.snapshots()
        if of is not None:
            heads = heads.join(of.select("fileset_id"), "fileset_id", "left_semi")
        source = snapshots.deliveries(self.table("filesets"), "files").where(F.col("n_files") > 0).select("fileset_id", "at", "tie", "files")
        same = (F.col("s.fileset_id") == F.col("h.fileset_id")) & F.col("s.at").eqNullSafe(F.col("h.at")) & (F.col("s.tie") == F.col("h.tie"))
        listed = heads.alias("h").join(source.alias("s"), same).select("h.fileset_id", "h.branch", "h.taken_at", F.posexplode("s.files").alias("pos", "f"))
        plain = F.transform(F.coalesce(F.col("f.blocks"), F.array()), lambda b: F.struct(element_key(b["hash"]).alias("hash"), b["size"].alias("size")))
        rows = listed.select("fileset_id", "branch", "taken_at", clean_path(F.col("f.path")).alias("path"), "pos", plain.alias("blocks")).where(F.col("path") != "")
        return rows.groupBy("fileset_id", "branch", "taken_at", "path").agg(F.max_by("blocks", "pos").alias("blocks"))

    def tip_refs(self) -> DataFrame:
        """``branch, path, seq, hash, size`` of the tips' snapshots."""
        sets = blocks.tip_sets(self.branches(), self.commits())
        return blocks.tip_refs(sets, self.entries(sets))

    def all_refs(self) -> DataFrame:
        """``branch, path, hash, size`` of every recorded reference, repeated rows once."""
        return self.table("block_refs").select("branch", key(F.col("fileset_id")).alias("fileset_id"), clean_path(F.col("path")).alias("path"), "seq", key(F.col("hash")).alias("hash"), "size").where(F.col("hash").isNotNull()).distinct()

    def triple(self, n: int) -> DataFrame:
        """Entries of the ``n``-th last snapshot of every branch: ``branch, path, blocks``."""
        last = F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("taken_at"), F.desc("fileset_id")))
        heads = self.snapshots().where(F.col("branch").isNotNull() & F.col("taken_at").isNotNull()).select("fileset_id", last.alias("n"))
        return self.entries(heads.where(F.col("n") == n)).select("branch", "path", "blocks")

    def lines(self) -> DataFrame:
        """Documents as files, lines as blocks: ``path, seq, hash, content``."""
        docs = self.table("documents").select("doc_id", "source", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).distinct()
        path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"))
        return docs.select(path.alias("path"), F.posexplode(F.split("text", "\n")).alias("seq", "content")).select("path", "seq", F.md5("content").alias("hash"), "content")

    def line_store(self) -> DataFrame:
        """A block store over the lines with gaps (``0..``) and damage (``1..``)."""
        kept = self.lines().where(~F.col("hash").startswith("0")).select("hash", "content").distinct()
        return kept.withColumn("content", F.when(F.col("hash").startswith("1"), F.concat("content", F.lit("?"))).otherwise(F.col("content")))
