"""Millions of tiny files into few well-sized ones: partition-local compaction.

Records are homed in partitions by (kind, bucket of the id), so all copies of a
record meet in one partition. Partitions fed by more small files than allowed
are rewritten, and only these, with dynamic partition overwrite. Every rewrite is
one numbered version of the table: it is committed after its data are written, by
a file created atomically, and only if no version since the one it was based on
replaced any of its partitions; so of two writers that want the same partitions
one gets :class:`Conflict`, and no record is lost or doubled.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.functions.normal import key

#: Partitions fed by more files than this are compacted.
SMALL_FILES = 16
#: Bytes of record text aimed at per written file.
TARGET_BYTES = 128 << 20
LEFTOVER = r"(^|[/\\])\.?tmp-[^/\\]*$"

RECORD = T.StructType(
    [
        T.StructField("record_kind", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("place", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
    ]
)

_decoder = json.JSONDecoder()
_BLANK = " \t\r\n\x0b\x0c\ufeff\x00"


def _objects(body: str) -> Iterator[dict]:
    """Complete JSON objects of a file: alone, in an array, or line by line.

    Objects before the cut of a torn array or file are complete and count, the
    cut-off one does not.
    """
    text = body.strip(_BLANK)
    if not text:
        return
    try:
        whole = json.loads(text)
    except (ValueError, RecursionError):
        whole = None
    if isinstance(whole, dict):
        yield whole
        return
    if isinstance(whole, list):
        yield from (x for x in whole if isinstance(x, dict))
        return
    at, n, closed = 0, len(text), text[0] == "["
    if closed:  # a torn array
        at = 1
        while at < n:
            while at < n and text[at] in _BLANK + ",":
                at += 1
            try:
                found, at = _decoder.raw_decode(text, at)
            except (ValueError, RecursionError):
                return
            if isinstance(found, dict):
                yield found
        return
    for line in text.splitlines():
        line = line.strip(_BLANK).rstrip(",")
        if not line.startswith(("{", "[")):
            continue
        try:
            found = json.loads(line)
        except (ValueError, RecursionError):
            continue
        for x in found if isinstance(found, list) else [found]:
            if isinstance(x, dict):
                yield x
    # one object over several lines followed by more: take what is complete
    if text[0] == "{" and "\n" in text and not text.split("\n", 1)[0].strip(_BLANK).endswith("}"):
        while at < n:
            try:
                found, at = _decoder.raw_decode(text, at)
            except (ValueError, RecursionError):
                return
            if isinstance(found, dict):
                yield found
            while at < n and text[at] in _BLANK + ",":
                at += 1


def _parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kinds, ids, records, files, places, times = [], [], [], [], [], []
        for name, body, when in zip(batch["file_name"], batch["body"], batch["modified_at"]):
            for place, x in enumerate(_objects(body)):
                kind, value = ("commit", x.get("id")) if x.get("id") is not None else ("block", x.get("hash"))
                if not isinstance(value, str) or not value.strip():
                    continue
                kinds.append(kind)
                ids.append(value.strip().lower())
                records.append(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace").decode())
                files.append(name)
                places.append(place)
                times.append(when)
        yield pd.DataFrame({"record_kind": kinds, "record_id": ids, "record": records, "file_name": files, "place": places, "modified_at": pd.Series(times, dtype=batch["modified_at"].dtype)})


def records(loose: DataFrame) -> DataFrame:
    """Complete records of loose files (``file_name, body, modified_at``).

    Leftovers (base name ``tmp-*`` or ``.tmp-*``), null and empty bodies hold
    none. Nothing is de-duplicated here.
    """
    files = loose.select("file_name", "body", "modified_at").where(F.col("body").isNotNull() & ~F.coalesce(F.col("file_name"), F.lit("")).rlike(LEFTOVER))
    return files.mapInPandas(_parse, RECORD)


def leftovers(loose: DataFrame) -> DataFrame:
    """Names of files that interrupted writes left behind (base name ``tmp-*`` or ``.tmp-*``)."""
    return loose.select("file_name").where(F.col("file_name").rlike(LEFTOVER)).distinct()


class Conflict(RuntimeError):
    """Another writer changed a partition since the version this one read."""


class VersionedTable:
    """A partitioned parquet table with numbered, atomically committed versions.

    Data lie in ``data/<partition columns>/attempt=<id>``; every attempt of a writer
    has its own id, so nothing a reader may hold is ever overwritten. A version is
    committed by creating ``_versions/<number>.json``, which appears whole and only if
    nobody has taken the number; it names the attempt, and ``_changes/attempt=<id>``
    lists the partitions it replaced. A reader of version ``v`` sees, of each
    partition, the attempt of the newest version up to ``v`` that replaced it: one
    version, whatever is written meanwhile. Attempts that failed or lost are in no
    version; :meth:`vacuum` deletes them and what no kept version shows.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ("record_kind", "bucket")) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(partition_by)
        jvm = spark.sparkContext._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the committed versions, ascending."""
        where = self._at("_versions")
        if not self._fs.exists(where):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(where) if s.getPath().getName().endswith(".json"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        stream = self._fs.open(self._at("_versions", f"{version:08d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, version: int, notes: dict) -> bool:
        """Create the version file, whole or not at all; false if the number is taken."""
        name = f"{version:08d}.json"
        target, draft = self._at("_versions", name), self._at("_versions", f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps({"version": version} | notes).encode())
        stream.close()
        try:
            if target.toUri().getScheme() in (None, "file") and self._fs.getUri().getScheme() == "file":
                folder = self._at("_versions").toUri().getPath()
                os.link(os.path.join(folder, draft.getName()), os.path.join(folder, name))  # fails if it exists
            else:
                jvm = self.spark.sparkContext._jvm
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, target, options)
        except Exception:
            if not self._fs.exists(target):
                raise
            return False
        finally:
            self._fs.delete(draft, False)
        return True

    def _changes(self, since: int, upto: int) -> DataFrame | None:
        """Partition columns, ``attempt``, ``version`` of the partitions replaced in ``(since, upto]``."""
        found = [(self.manifest(v)["attempt"], v) for v in self.versions() if since < v <= upto]
        if not found:
            return None
        paths = [f"{self.path}/_changes/attempt={a}" for a, _ in found]
        rows = self.spark.read.option("basePath", f"{self.path}/_changes").parquet(*paths)
        return rows.join(F.broadcast(self.spark.createDataFrame(found, "attempt string, version int")), "attempt")  # one row a version

    def check(self, base: int, partitions: DataFrame) -> int:
        """The newest version, if none after ``base`` replaced one of ``partitions``."""
        now = self.version()
        changed = self._changes(base, now)
        if changed is not None and (clash := changed.join(partitions.select(*self.keys), self.keys, "left_semi").first()):
            raise Conflict(f"version {clash['version']} changed {clash.asDict()} after version {base}")
        return now

    def rewrite(self, rows: DataFrame, partitions: DataFrame, base: int, **notes: int) -> int:
        """Replace just ``partitions`` by ``rows``, which were made from version ``base``.

        The data are written first, by dynamic partition overwrite below the writer's
        own attempt; then conflicts are looked for and the next number is taken. If
        another writer takes it, conflicts are looked for again. So a version counts
        only with its data in place, and of two writers of one base and partition the
        second to commit gets :class:`Conflict`. Partitions without rows become empty.
        """
        attempt = uuid.uuid4().hex
        listed = partitions.select(*self.keys)
        self.check(base, listed)
        rows.withColumn("attempt", F.lit(attempt)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.keys, "attempt").parquet(f"{self.path}/data")
        listed.write.mode("overwrite").parquet(f"{self.path}/_changes/attempt={attempt}")
        while True:
            new = self.check(base, listed) + 1
            if self._publish(new, {"base": base, "attempt": attempt} | notes):
                return new

    def _current(self, version: int) -> DataFrame | None:
        """Partition columns and the ``attempt`` that holds them at ``version``."""
        changed = self._changes(0, version)
        return None if changed is None else changed.groupBy(*self.keys).agg(F.max_by("attempt", "version").alias("attempt"))

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The rows of ``version`` (default: the newest); later commits do not show in it."""
        current = self._current(self.version() if version is None else version)
        if current is None or not self._fs.exists(self._at("data")):
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
        return self.spark.read.schema(full).parquet(f"{self.path}/data").join(current, [*self.keys, "attempt"], "left_semi").select(*schema.fieldNames())

    def vacuum(self, keep_from: int) -> int:
        """Delete what neither version ``keep_from`` nor a later one shows; number of folders.

        Not to be run while a writer is at work: its attempt is in no version yet.
        """
        versions = [v for v in self.versions() if v >= keep_from]
        kept = {row[0] for v in versions for row in self._current(v).select("attempt").distinct().toLocalIterator()}
        gone = 0
        for s in self._fs.globStatus(self._at("data", *["*"] * len(self.keys), "attempt=*")) or []:
            if s.getPath().getName().split("=", 1)[1] not in kept:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone


TABLE = T.StructType([*RECORD.fields, T.StructField("bucket", T.IntegerType())])


def latest_copies(found: DataFrame, extra: list[str]) -> DataFrame:
    """Each record once: its latest copy, then file name and place decide ties."""
    pick = F.max_by(F.struct("record", "file_name", "place", "modified_at"), F.struct(F.col("modified_at").alias("m"), F.col("file_name").alias("f"), F.col("place").alias("p"), F.col("record").alias("r")))
    return found.groupBy("record_kind", "record_id", *extra).agg(pick.alias("x")).select("record_kind", "record_id", "x.record", "x.file_name", "x.place", "x.modified_at", *extra)


def _homed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int"))


def compact(loose: DataFrame, table: VersionedTable, small_files: int = SMALL_FILES, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Consolidate loose files into ``table``; returns all records, each once.

    Partitions with over ``small_files`` feeding files are rewritten together with
    what the table holds of them, and only these; the records of the others are read
    from their loose files, which stay, and from the table, the latest copy counting.
    Buckets are a power of two that follows the bytes of record text; when the table
    outgrows them by a factor of two they double, and that one time every partition
    is rewritten. An empty table of files changes nothing. Raises :class:`Conflict`
    if another writer has replaced one of the partitions meanwhile; nothing is lost
    then, and the call may be repeated.
    """
    from strataforge.session import cut

    base = table.version()
    notes = table.manifest(base) if base else {"buckets": 0, "bytes": 0}
    found = cut(records(loose), "loose-records")
    fresh = found.agg(F.coalesce(F.sum(F.octet_length("record")), F.lit(0))).first()[0]
    total, before = notes["bytes"] + fresh, notes["buckets"]
    buckets = before or 1
    while total > 2 * buckets * target_bytes:
        buckets *= 2
    found = _homed(found, buckets)
    parts = ["record_kind", "bucket"]
    old = table.read(TABLE, base)
    if before and buckets != before:  # every partition splits
        old = _homed(old, buckets)
        chosen = cut(found.select(*parts).unionByName(old.select(*parts)).distinct(), "partitions")
        listed = chosen.unionByName(table._current(base).select(*parts)).distinct()
    else:
        fed = found.groupBy(*parts).agg(F.approx_count_distinct("file_name", 0.02).alias("n")).where(F.col("n") > small_files)
        listed = chosen = cut(fed.select(*parts), "partitions")
    if chosen.isEmpty():
        return latest_copies(found.drop("bucket").unionByName(old.drop("bucket")), [])
    mine = found.join(chosen, parts, "left_semi").unionByName(old.join(chosen, parts, "left_semi")).select(*TABLE.fieldNames())
    version = table.rewrite(latest_copies(mine, ["bucket"]).repartition(*parts), listed, base, buckets=buckets, bytes=total)
    done = table.read(TABLE, version)
    rest = found.join(chosen, parts, "left_anti").unionByName(done.join(chosen, parts, "left_anti")).select(*TABLE.fieldNames())
    return done.join(chosen, parts, "left_semi").drop("bucket").unionByName(latest_copies(rest, []))
