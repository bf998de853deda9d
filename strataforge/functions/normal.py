"""Column expressions that bring keys, paths and times into one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that is cut off keys.
SPACES = " \t\n\r\x0b\x0c\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def _tidy(c: Column) -> Column:
    """Trimmed and lower case; the slow trim of all white space runs only where needed."""
    bare = F.trim(c)
    visible = lambda x: F.ascii(x).between(33, 126)
    return F.lower(F.when(visible(bare) & visible(F.substring(bare, -1, 1)), bare).otherwise(F.btrim(c, F.lit(SPACES))))


def key(c: Column) -> Column:
    """Trimmed, lower-case key; null for null and for nothing but white space."""
    return F.nullif(_tidy(c), F.lit(""))


def element_key(c: Column) -> Column:
    """:func:`key` for use inside a lambda."""
    k = _tidy(c)
    return F.when(k != "", k)


def pack(c: Column) -> Column:
    """A string as binary, lower-case hex in half its length; :func:`unpack` gives it back."""
    return F.when(c.rlike("^(?:[0-9a-f]{2})+$"), F.concat(F.unhex(F.lit("01")), F.unhex(c))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def unpack(b: Column) -> Column:
    rest = F.substring(b, 2, 1 << 30)
    return F.when(F.substring(b, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def clean_path(c: Column) -> Column:
    r"""``\`` is ``/``; empty and ``.`` segments vanish; ``..`` removes the one before.

    Already clean paths, the rule, skip the segment work. A leading ``..`` has
    nothing to remove and vanishes; a path of no segments is the empty string.
    """
    def segments() -> Column:
        return F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))

    climbing = F.aggregate(
        segments(),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    # plain searches decide for nearly all paths; a false alarm only takes the longer way
    odd = c.startswith("/") | c.endswith("/") | c.endswith(".") | c.contains("\\") | c.contains("//") | c.contains("./")
    return F.when(~odd, c).when(~c.contains(".."), F.array_join(segments(), "/")).otherwise(F.array_join(climbing, "/"))


def rfc3339(c: Column) -> Column:
    """The instant of a valid RFC 3339 string, else null (never an error)."""
    s = F.upper(F.btrim(c, F.lit(SPACES)))
    return F.when(s.rlike(RFC3339), s.try_cast("timestamp"))


def utc_month(ts: Column) -> Column:
    """``YYYY-MM`` in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")


def fingerprint(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row; nulls differ from every value.

    ``xxhash64`` skips nulls, so a mask of the null positions is hashed too.
    128 bits keep the chance of one collision among 10^12 rows under 1e-14.
    """
    nulls = F.lit(0)
    for i, c in enumerate(cols):
        nulls = nulls + F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return F.xxhash64(F.lit(17), nulls, *cols), F.xxhash64(F.lit(7919), nulls, *cols)


def counting_rows(df: DataFrame, id_col: str, content: list[str]) -> DataFrame:
    """One row per key: contents of the latest ``arrived_at``, and the earliest.

    Returns ``id_col``, ``content`` and ``first_arrived``. A null ``arrived_at``
    is older than all others as contents and ignored for the earliest. Rows that
    tie on the latest ``arrived_at`` but differ are ordered by a hash of their
    contents, so the result is one and the same on every run. Hash-aggregated
    with partial combining: a key with very many rows is reduced before the
    shuffle.
    """
    tie = F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in content])
    picked = F.max(F.struct(F.col("arrived_at").alias("a"), tie.alias("t"), F.struct(*[F.col(c) for c in content]).alias("c")))
    return (
        df.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(picked.alias("_p"), F.min("arrived_at").alias("first_arrived"))
        .select(id_col, *[F.col("_p.c")[c].alias(c) for c in content], "first_arrived")
    )
