"""The working tree as a source: listing, classes, blocks of files.

Spark's own binary source is not used: it drops empty files and names that begin
with a dot or an underscore, which belong to the tree.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions.chunking import MAX_BLOCK, MIN_BLOCK, MODULUS, block_hash, cut_points
from strataforge.functions.glob import glob_regex, rules

IGNORE_FILE = ".strata-ignore"
#: Bytes read at a time beyond the largest block.
READ_BYTES = 32 << 20

PIECE = "path string, seq int, hash string, size bigint, offset bigint, content binary"


def read_rules(root: str) -> tuple[list[str], list[str]]:
    where = os.path.join(root, IGNORE_FILE)
    if not os.path.exists(where):
        return rules([])
    with open(where, encoding="utf-8") as file:
        return rules(file)


def listing(root: str) -> Iterator[tuple[str, bool]]:
    """(path, ignored) of all files; an ignored folder is one item, not entered."""
    static, patterns = read_rules(root)
    tests = [re.compile(r) for p in patterns if (r := glob_regex(p))]
    hit = lambda path: path in static or any(t.search(path) for t in tests)
    for folder, folders, files in os.walk(root):
        below = os.path.relpath(folder, root).replace(os.sep, "/")
        full = lambda name, below=below: name if below == "." else f"{below}/{name}"
        for name in list(folders):
            if hit(full(name)):
                folders.remove(name)
                yield full(name), True
        for name in files:
            yield full(name), hit(full(name))


def scan(spark: SparkSession, root: str, index: DataFrame) -> DataFrame:
    """``path, class``: ignored, else staged if in ``index`` (``path``), else tracked."""
    rows = spark.createDataFrame(list(listing(root)), "path string, hit boolean")
    known = index.select("path").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "path", "left").select("path", F.when(F.col("hit"), "ignored").when(F.col("known"), "staged").otherwise("tracked").alias("class"))


def split_stream(file, smallest: int, largest: int, modulus: int) -> Iterator[bytes]:
    """Blocks of an open file, holding little more than one block in memory.

    Every cut but the last of a buffer is final: a cut depends on the block's
    start and the bytes before it only.
    """
    held = b""
    while True:
        more = file.read(READ_BYTES + largest)
        held += more
        ends = cut_points(held, smallest, largest, modulus)
        start = 0
        for end in ends if not more else ends[:-1]:
            yield held[start:end]
            start = end
        held = held[start:]
        if not more:
            return


def pieces(files: DataFrame, root: str, smallest: int = MIN_BLOCK, largest: int = MAX_BLOCK, modulus: int = MODULUS, contents: bool = True) -> DataFrame:
    """Blocks of the files ``path`` below ``root`` (a folder all executors see).

    Empty files give one row with a null ``seq``. Files are read inside the
    worker, once, and hashed in the same pass.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows, offset, size = [], 0, 0
                with open(os.path.join(root, path), "rb") as file:
                    for seq, data in enumerate(split_stream(file, smallest, largest, modulus)):
                        rows.append((path, seq, block_hash(data), len(data), offset, data if contents else None))
                        offset += len(data)
                        size += len(data)
                        if size > READ_BYTES:
                            yield pd.DataFrame(rows, columns=["path", "seq", "hash", "size", "offset", "content"])
                            rows, size = [], 0
                if rows or not offset:
                    yield pd.DataFrame(rows or [(path, None, None, None, None, None)], columns=["path", "seq", "hash", "size", "offset", "content"])

    return files.select("path").mapInPandas(run, PIECE)


def entries_of(found: DataFrame) -> DataFrame:
    """``path, blocks`` from pieces; an empty file has an empty list."""
    block = F.struct("seq", "hash", "size")
    listed = F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), block)))
    return found.groupBy("path").agg(listed.alias("b")).select("path", F.transform("b", lambda x: F.struct(x["hash"].alias("hash"), x["size"].alias("size"))).alias("blocks"))


def write_files(contents: DataFrame, root: str) -> None:
    """Write ``path, seq, content`` as files below ``root``; others are left alone.

    Rows of a path come in order of ``seq`` to one task; a file appears under its
    name when it is whole.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, file = None, None

        def finish() -> None:
            if file is not None:
                file.close()
                os.replace(file.name, os.path.join(root, current))

        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                if path != current:
                    finish()
                    current = path
                    where = os.path.join(root, path)
                    os.makedirs(os.path.dirname(where) or ".", exist_ok=True)
                    file = open(os.path.join(os.path.dirname(where), f".tmp-{uuid.uuid4().hex}"), "wb")  # noqa: SIM115
                if data is not None:
                    file.write(bytes(data))
        finish()
        yield pd.DataFrame({"n": [0]})

    contents.repartition("path").sortWithinPartitions("path", "seq").select("path", "content").mapInPandas(run, "n int").count()
