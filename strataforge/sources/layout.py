"""The JSON directory layout: commits, snapshots, branch pointers, HEAD, index.

Commit and snapshot files are pretty-printed JSON, one document a file; entries
carry the keys ``Path`` and ``Blocks``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = "struct<hash:string,size:bigint,offset:bigint>"
COMMIT = "id string, parents array<string>, branch string, message string, timestamp string, fileset_id string"
FILESET = f"id string, files array<struct<Path:string,Blocks:array<{_BLOCK}>>>"
ENTRY = f"Path string, Blocks array<{_BLOCK}>"


#: Begin of the names of files that are being written.
TEMPORARY = ".tmp-"


def clean_temporary(folder: str) -> int:
    """Delete what interrupted writes left in ``folder``; not while one is at work. Number of files."""
    gone = 0
    for entry in os.scandir(folder) if os.path.isdir(folder) else ():
        if entry.is_file() and entry.name.startswith((TEMPORARY, TEMPORARY[1:])):
            os.remove(entry.path)
            gone += 1
    return gone


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    """All commits; a file that is no valid JSON is an error."""
    return spark.read.schema(COMMIT).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/commits")


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """``fileset_id, path, blocks`` of all snapshots; null ``Blocks`` are empty files."""
    sets = spark.read.schema(FILESET).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/snapshots")
    files = sets.select(F.col("id").alias("fileset_id"), F.explode("files").alias("f"))
    return files.select("fileset_id", F.col("f.Path").alias("path"), F.coalesce("f.Blocks", F.array().cast(f"array<{_BLOCK}>")).alias("blocks"))


def read_branches(spark: SparkSession, root: str) -> DataFrame:
    """``name, tip``: one small text file each; an empty one is an empty branch."""
    rows = spark.read.text(f"{root}/branches/*", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("tip"))
    return rows.select(F.url_decode("name").alias("name"), F.trim("tip").alias("tip")).orderBy("name")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """``path, blocks`` of the staging index; without a file it is empty, bad JSON is an error."""
    if not _exists(spark, f"{root}/index.json"):
        return spark.createDataFrame([], f"path string, blocks array<{_BLOCK}>")
    rows = spark.read.schema(ENTRY).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/index.json")
    return rows.select(F.col("Path").alias("path"), F.coalesce("Blocks", F.array().cast(f"array<{_BLOCK}>")).alias("blocks"))


def read_head(spark: SparkSession, root: str) -> str:
    """Current branch from ``ref: branches/<name>``; anything else is an error."""
    text = spark.read.text(f"{root}/HEAD", wholetext=True).first()[0].strip()
    if not text.startswith("ref: "):
        raise ValueError(f"HEAD is no reference: {text!r}")
    return text.rsplit("/", 1)[-1]


def write_documents(rows: DataFrame, folder: str, name: str, document: str) -> None:
    """One pretty-printed JSON file per row: column ``name`` names it, ``document`` is its JSON text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for key, text in zip(batch["name"], batch["document"]):
                where = os.path.join(folder, f"{key}.json")
                draft = os.path.join(folder, f"{TEMPORARY}{uuid.uuid4().hex}")
                with open(draft, "w", encoding="utf-8") as file:
                    json.dump(json.loads(text), file, indent=2, ensure_ascii=False)
                os.replace(draft, where)
        yield pd.DataFrame({"n": [0]})

    rows.select(F.col(name).alias("name"), F.col(document).alias("document")).mapInPandas(run, "n int").count()


def write_layout(root: str, commits: DataFrame, entries: DataFrame) -> None:
    """Commits and snapshots as JSON files below ``root``."""
    write_documents(commits.select("id", F.to_json(F.struct("id", "parents", "branch", "message", "timestamp", "fileset_id"), {"ignoreNullFields": "false"}).alias("d")), f"{root}/commits", "id", "d")
    sets = entries.groupBy("fileset_id").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("Path"), F.col("blocks").alias("Blocks")))).alias("files"))
    write_documents(sets.select("fileset_id", F.to_json(F.struct(F.col("fileset_id").alias("id"), "files")).alias("d")), f"{root}/snapshots", "fileset_id", "d")


def write_branches(rows: DataFrame, root: str) -> None:
    """``name, tip`` as one text file each; a null tip is an empty file."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = os.path.join(root, "branches")
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, tip in zip(batch["name"], batch["tip"]):
                draft = os.path.join(root, f"{TEMPORARY}{uuid.uuid4().hex}")
                with open(draft, "w", encoding="utf-8") as file:
                    file.write(tip or "")
                os.replace(draft, os.path.join(folder, name))
        yield pd.DataFrame({"n": [0]})

    rows.select("name", "tip").mapInPandas(run, "n int").count()
