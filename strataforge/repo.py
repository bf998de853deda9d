"""A repository in a folder, with the commands of the reference as methods.

Tables are parquet: ``commits``, ``entries`` (by commit), ``blocks``, ``index``;
HEAD and branch tips are small text files. Clock and ids are arguments, so a run
can be repeated. Every change writes data first and moves the pointer last, and only
if the pointer still is what the change started from. Commands that build on stored
blocks verify them first.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import chunking
from strataforge.operators import blocks, diff, graph, log
from strataforge.session import cut
from strataforge.sources import worktree

COMMITS = "id string, parents array<string>, branch string, message string, timestamp string, fileset_id string"
ENTRIES = f"commit_id string, path string, blocks {diff.BLOCKS}"
BLOCKS = "hash string, size bigint, content binary"
INDEX = f"path string, blocks {diff.BLOCKS}"


class RepositoryError(RuntimeError):
    """A command that cannot be carried out."""


class Repo:
    def __init__(self, spark: SparkSession, root: str, tree: str, smallest: int = chunking.MIN_BLOCK, largest: int = chunking.MAX_BLOCK, modulus: int = chunking.MODULUS, clock=None, guard: bool = True) -> None:
        """``guard``: verify the blocks of all tips before a command that changes something."""
        self.spark, self.root, self.tree, self.guard = spark, root.rstrip("/"), tree, guard
        self.cutting = {"smallest": smallest, "largest": largest, "modulus": modulus}
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- storage ------------------------------------------------------------

    def _read(self, name: str) -> str | None:
        where = self._path(f"{self.root}/{name}")
        if not self._fs.exists(where):
            return None
        stream = self._fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), True)
        stream.write(text.encode())
        stream.close()

    def _move(self, branch: str, old: str | None, new: str) -> None:
        """Set a tip from ``old`` to ``new``; an error if another writer has moved it meanwhile.

        The lock is a file that is created only where there is none.
        """
        lock = self._path(f"{self.root}/locks/{branch}")
        try:
            self._fs.create(lock, False).close()
        except Exception as error:
            raise RepositoryError(f"branch {branch} is locked by another writer (or by one that died: remove {lock})") from error
        try:
            if self.tip(branch) != old:
                raise RepositoryError(f"branch {branch} has moved from {old!r}; nothing is lost, repeat the command")
            self._write(f"branches/{branch}", new)
        finally:
            self._fs.delete(lock, False)

    def check_blocks(self) -> None:
        """An error that names the first bad block of any tip, if there is one."""
        if self._fs.exists(self._path(f"{self.root}/entries")) and (bad := blocks.first_bad(blocks.verify(self.tip_refs(), self.store(), chunking.xxh3)).first()):
            raise RepositoryError(f"block {bad['hash']} is {bad['status'].lower()}; run block_repair first")

    def _guard(self) -> None:
        if self.guard:
            self.check_blocks()

    def read_block(self, hash: str) -> bytes | None:
        """The contents of one block; null if it is not stored."""
        found = self.store().where(F.col("hash") == hash).select("content").first()
        return None if found is None else bytes(found["content"])

    def table(self, name: str, schema: str) -> DataFrame:
        if not self._fs.exists(self._path(f"{self.root}/{name}")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def commits(self) -> DataFrame:
        return self.table("commits", COMMITS).withColumn("ts", F.try_to_timestamp("timestamp"))

    def entries(self, commit: str | None) -> DataFrame:
        rows = self.table("entries", ENTRIES)
        return rows.where(F.col("commit_id") == commit).select("path", "blocks") if commit else rows.limit(0).select("path", "blocks")

    def store(self) -> DataFrame:
        return self.table("blocks", BLOCKS)

    def index(self) -> DataFrame:
        return self.table("index", INDEX)

    def _save_index(self, rows: DataFrame) -> None:
        cut(rows, "index").write.mode("overwrite").parquet(f"{self.root}/index")

    # --- branches -----------------------------------------------------------

    def init(self, branch: str = "main") -> None:
        """Empty repository; running it again keeps everything."""
        if self._read("HEAD") is None:
            self._write("branches/main", "")
            self.set_head(branch)

    def set_head(self, branch: str) -> None:
        if "/" in branch or not branch:
            raise RepositoryError(f"not a branch name: {branch!r}")
        self._write("HEAD", f"ref: branches/{branch}")

    def current(self) -> str:
        head = self._read("HEAD") or ""
        if not head.startswith("ref: "):
            raise RepositoryError("no HEAD; run init first")
        return head.rsplit("/", 1)[-1]

    def tip(self, branch: str | None = None) -> str | None:
        return self._read(f"branches/{branch or self.current()}") or None

    def branch_names(self) -> list[str]:
        where = self._path(f"{self.root}/branches")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def branches(self) -> DataFrame:
        return self.spark.createDataFrame([(n, self.tip(n)) for n in self.branch_names()], "name string, tip string")

    def branch(self, name: str) -> None:
        if "/" in name or not name:
            raise RepositoryError(f"not a branch name: {name!r}")
        if name in self.branch_names():
            raise RepositoryError(f"branch {name} exists")
        self._guard()
        self._write(f"branches/{name}", self.tip() or "")

    # --- staging and commits ------------------------------------------------

    def scan(self) -> DataFrame:
        return worktree.scan(self.spark, self.tree, self.index())

    def _pieces(self, files: DataFrame, contents: bool = True) -> DataFrame:
        return worktree.pieces(files, self.tree, contents=contents, **self.cutting)

    def add(self, *specs: str, update: bool = False) -> int:
        """Stage the files of any of ``specs`` (default all); with ``update`` only those the last commit knows."""
        self._guard()
        rows = self.scan().where(F.col("class") != "ignored").select("path")
        if update:
            rows = rows.join(self.entries(self.tip()), "path", "left_semi").select("path")
        chosen = [diff.pathspec(rows, spec) for spec in specs or (".",)]
        rows = reduce(DataFrame.unionByName, chosen).distinct()
        fresh = cut(worktree.entries_of(self._pieces(rows, contents=False)), "staged")
        self._save_index(diff.upsert(self.index(), fresh, ["path"]))
        return fresh.count()

    def _store_blocks(self, rows: DataFrame) -> None:
        """Add blocks of files the store lacks; hashed in the pass that read them."""
        listed = self._pieces(rows, contents=False).where(F.col("seq").isNotNull()).select("path", "hash", "size")
        # by hash first: only files with a block that lacks are read for their contents
        lacking = cut(listed.join(self.store().select("hash", "size"), ["hash", "size"], "left_anti"), "lacking")
        found = self._pieces(lacking.select("path").distinct()).where(F.col("seq").isNotNull()).join(lacking.select("hash").distinct(), "hash", "left_semi")
        found.dropDuplicates(["hash"]).select("hash", "size", "content").write.mode("append").parquet(f"{self.root}/blocks")

    def _new_id(self) -> str:
        return f"{time.time_ns():x}"

    def _record(self, commit: str, parents: list[str], message: str, rows: DataFrame) -> str:
        kept = rows.select(F.lit(commit).alias("commit_id"), "path", "blocks")
        kept.write.mode("append").parquet(f"{self.root}/entries")
        content = blocks.fileset_ids(kept.withColumnRenamed("commit_id", "fileset_id"), chunking.xxh3).first()
        row = (commit, parents, self.current(), message, self.clock().strftime("%Y-%m-%dT%H:%M:%SZ"), content["content_id"] if content else None)
        self.spark.createDataFrame([row], COMMITS).write.mode("append").parquet(f"{self.root}/commits")
        self._move(self.current(), parents[0] if parents else None, commit)
        return commit

    def commit(self, message: str, id: str | None = None, allow_empty: bool = False) -> str:
        """A snapshot of the index (and of nothing else)."""
        self._guard()
        staged = cut(self.index(), "index")
        if staged.isEmpty() and not allow_empty:
            raise RepositoryError("nothing staged")
        self._store_blocks(staged.where(F.size("blocks") > 0).select("path"))
        tip = self.tip()
        done = self._record(id or self._new_id(), [tip] if tip else [], message, staged)
        self._save_index(staged.limit(0))
        return done

    def status(self, show_untracked: bool = True) -> DataFrame:
        classes = self.scan()
        work = worktree.entries_of(self._pieces(classes.where(F.col("class") == "tracked"), contents=False))
        return diff.status(self.entries(self.tip()), self.index(), work, ["path"], show_untracked)

    def log(self, all_branches: bool = False, **options) -> DataFrame:
        tips = self.branches().where(F.col("tip").isNotNull())
        if not all_branches:
            tips = tips.where(F.col("name") == self.current())
        if tips.isEmpty():
            return self.commits().limit(0)
        seen = graph.history(self.commits(), tips.select(F.col("tip").alias("id")))
        return log.log(self.commits().join(seen, "id", "left_semi"), **options)

    # --- moving around ------------------------------------------------------

    def _known(self, commit: str | None) -> str:
        if not commit or self.commits().where(F.col("id") == commit).isEmpty():
            raise RepositoryError(f"no commit {commit!r}")
        return commit

    def restore(self, rows: DataFrame) -> None:
        """Write entries into the tree; files that are not among them stay."""
        rows = cut(rows, "restore")
        parts = rows.select("path", F.posexplode_outer("blocks").alias("seq", "b")).select("path", "seq", F.col("b.hash").alias("hash"))
        wanted = self.store().select("hash", "content").join(parts.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
        full = cut(parts.join(wanted, "hash", "left").select("path", F.coalesce("seq", F.lit(0)).alias("seq"), "hash", "content"), "contents")
        if bad := full.where(F.col("hash").isNotNull() & F.col("content").isNull()).first():
            raise RepositoryError(f"block {bad['hash']} of {bad['path']} is missing")
        worktree.write_files(full, self.tree)

    def checkout(self, branch: str) -> None:
        if branch not in self.branch_names():
            raise RepositoryError(f"no branch {branch}")
        self._guard()
        self.restore(self.entries(self.tip(branch)))
        self.set_head(branch)

    def reset(self, commit: str, mode: str = "mixed") -> None:
        """``soft`` moves the tip, ``mixed`` also the index, ``hard`` also the tree."""
        self._known(commit)
        self._guard()
        old = self.tip()
        if mode in ("mixed", "hard"):
            self._save_index(self.entries(commit))
        if mode == "hard":
            self.restore(self.entries(commit))
        self._move(self.current(), old, commit)

    def cherry_pick(self, commit: str, id: str | None = None) -> str:
        """A commit of the picked commit's whole snapshot on the current branch."""
        self._known(commit)
        self._guard()
        message = self.commits().where(F.col("id") == commit).first()["message"]
        tip, rows = self.tip(), cut(self.entries(commit), "picked")
        done = self._record(id or self._new_id(), [tip] if tip else [], message, rows)
        self.restore(rows)
        return done

    def merge(self, branch: str, id: str | None = None) -> tuple[str, DataFrame]:
        """Three-way merge of ``branch``; returns the commit and the conflicting paths."""
        ours, theirs = self._known(self.tip()), self._known(self.tip(branch))
        self._guard()
        pair = self.spark.createDataFrame([("m", ours, theirs)], "query string, a string, b string")
        base = graph.Compressed(self.commits()).merge_bases(pair).first()["base"]
        rows = cut(diff.merged(diff.merge_verdicts(self.entries(base), self.entries(ours), self.entries(theirs), ["path"])), "merged")
        done = self._record(id or self._new_id(), [ours, theirs], f"Merge {branch} into {self.current()}", rows)
        self.restore(rows.select("path", "blocks"))
        return done, rows.where("conflict").select("path")

    # --- blocks -------------------------------------------------------------

    def tip_refs(self) -> DataFrame:
        entries = self.table("entries", ENTRIES)
        tips = self.branches().where(F.col("tip").isNotNull()).select(F.col("name").alias("branch"), F.col("tip").alias("commit_id"))
        return blocks.explode_blocks(entries.join(tips, "commit_id").select("branch", "path", "blocks"))

    def block_list(self) -> DataFrame:
        return blocks.inventory(self.tip_refs()).orderBy("hash")

    def block_reuse(self) -> DataFrame:
        return blocks.reuse_summary(self.tip_refs(), self.branches())

    def block_scan(self) -> DataFrame:
        """``hash, status, files, branches`` of all blocks the tips need."""
        checks = blocks.verify(self.tip_refs(), self.store(), chunking.xxh3)
        return checks.join(blocks.inventory(self.tip_refs()).select("hash", "files", "branches"), "hash")

    def block_repair(self) -> DataFrame:
        """Rebuild bad blocks from files of the tree; returns the checks afterwards."""
        bad = cut(self.block_scan().where(F.col("status") != "OK"), "bad")
        have = self.scan().where(F.col("class") != "ignored").select("path")
        files = bad.select(F.explode("files").alias("path")).distinct().join(have, "path", "left_semi").select("path")
        found = cut(self._pieces(files).join(bad.select("hash"), "hash", "left_semi").dropDuplicates(["hash"]).select("hash", "size", "content"), "rebuilt")
        # only the files of the store that hold a bad copy are written anew, and deleted after that
        where = F.col("_metadata.file_path")
        stored = self.store().select("*", where.alias("file"))
        old = cut(stored.join(found.select("hash"), "hash", "left_semi").select("file").distinct(), "store-files")
        kept = stored.join(old, "file", "left_semi").join(found.select("hash"), "hash", "left_anti").select("hash", "size", "content")
        kept.unionByName(found).write.mode("append").parquet(f"{self.root}/blocks")
        for row in old.toLocalIterator():
            self._fs.delete(self._path(row["file"]), False)
        return blocks.verify(bad, self.store(), chunking.xxh3)

    def repair_totals(self, after: DataFrame) -> DataFrame:
        """``status, n_blocks`` of the checks that :meth:`block_repair` returned."""
        return after.groupBy("status").agg(F.count(F.lit(1)).alias("n_blocks"))
