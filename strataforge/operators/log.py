"""The commit log: filters, order, references to branches."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.strings import first_line, log_date, short_id


def log(commits: DataFrame, since: str | None = None, until: str | None = None, branch: str | None = None, limit: int = 0) -> DataFrame:
    """Commits newest first, ties by id descending.

    A commit reached through several branches shows once; one without a readable
    time is dropped. ``since`` and ``until`` are ``YYYY-MM-DD`` and mean midnight
    UTC, so the day of ``until`` itself is mostly left out; a malformed date is an
    error. ``limit`` 0 shows all.
    """
    rows = commits.where(F.col("ts").isNotNull()).dropDuplicates(["id"])
    if branch is not None:
        rows = rows.where(F.col("branch") == branch)
    for day, test in ((since, lambda d: F.col("ts") >= d), (until, lambda d: F.col("ts") <= d)):
        if day is not None:
            date.fromisoformat(day)
            rows = rows.where(test(F.lit(f"{day}T00:00:00Z").cast("timestamp")))
    rows = rows.orderBy(F.desc("ts"), F.desc("id"))
    return rows.limit(limit) if limit > 0 else rows


def oneline(rows: DataFrame) -> DataFrame:
    """Short id and first line of the message."""
    return rows.select(short_id(F.col("id")).alias("short_id"), F.coalesce(first_line(F.col("message")), F.lit("")).alias("subject"))


def with_refs(commits: DataFrame, branches: DataFrame, head: str) -> DataFrame:
    """Commits that are tips, with their branches; the current branch comes first."""
    shown = F.when(F.col("name") == head, F.concat(F.lit("HEAD -> "), F.col("name"))).otherwise(F.col("name"))
    tips = branches.where(F.col("tip").isNotNull()).select(F.col("tip").alias("id"), F.struct((F.col("name") != head).alias("later"), F.col("name").alias("name"), shown.alias("shown")).alias("r"))
    names = tips.groupBy("id").agg(F.array_sort(F.collect_set("r")).alias("r"))
    return commits.join(names, "id").select("id", F.array_join(F.transform("r", lambda x: x["shown"]), ", ").alias("refs"), (F.coalesce(F.size("parents"), F.lit(0)) > 1).alias("is_merge"))


def detailed(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """The long form: ``id, header, merge_line, date_line, body``.

    ``refs``: ``id, refs`` of :func:`with_refs`. ``merge_line`` is null unless there
    are several parents; every line of the message is indented by four blanks.
    """
    known = commits.join(refs.select("id", "refs"), "id", "left")
    header = F.concat(F.lit("commit "), F.col("id"), F.when(F.col("refs").isNotNull(), F.concat(F.lit(" ("), "refs", F.lit(")"))).otherwise(""))
    parents = F.filter("parents", lambda p: p.isNotNull())
    merge = F.when(F.size(parents) > 1, F.concat(F.lit("Merge: "), F.array_join(F.transform(parents, short_id), " ")))
    body = F.concat(F.lit("    "), F.replace(F.coalesce("message", F.lit("")), F.lit("\n"), F.lit("\n    ")))
    return known.select("id", header.alias("header"), merge.alias("merge_line"), F.concat(F.lit("Date:   "), log_date(F.col("ts"))).alias("date_line"), body.alias("body"))
