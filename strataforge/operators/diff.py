"""Three-way comparisons of entries: working-tree status and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<hash:string,size:bigint>>"


def same(a: Column, b: Column) -> Column:
    """Entry equality: the ordered (hash, size) lists; both missing (null) are equal.

    An empty file is an empty list, which differs from a missing one.
    """
    bare = lambda c: F.transform(c, lambda x: F.struct(x["hash"].alias("hash"), x["size"].alias("size")))
    return bare(a).eqNullSafe(bare(b))


def three_way(keys: list[str], **sides: DataFrame) -> DataFrame:
    """Full outer join of the sides (``keys, blocks``) on the same keys.

    One shuffle a side and none in between: the sides are stacked, each with its
    own column, and grouped once.
    """
    stacked = None
    for name, df in sides.items():
        row = df.select(*keys, *[(F.col("blocks") if n == name else F.lit(None)).cast(BLOCKS).alias(n) for n in sides])
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.groupBy(*keys).agg(*[F.first(n, ignorenulls=True).alias(n) for n in sides])


def status(head: DataFrame, staged: DataFrame, work: DataFrame, keys: list[str], show_untracked: bool = True) -> DataFrame:
    """``keys, staged, unstaged`` codes; ``??`` for untracked, unchanged left out."""
    t = three_way(keys, h=head, s=staged, w=work)
    h, s, w = (F.col(c).isNotNull() for c in "hsw")
    t = t.withColumn("staged", F.when(s & ~h, "A").when(s & h & ~same(F.col("h"), F.col("s")), "M").when(h & ~w & s, "D"))
    t = t.withColumn("unstaged", F.when(w & h & ~same(F.col("h"), F.col("w")), "M").when(h & ~w & ~s, "D"))
    untracked = F.col("staged").isNull() & F.col("unstaged").isNull() & ~s & ~h & w & F.lit(show_untracked)
    t = t.withColumn("untracked", untracked)
    shown = t.where(F.col("staged").isNotNull() | F.col("unstaged").isNotNull() | F.col("untracked"))
    return shown.select(*keys, F.when(F.col("untracked"), "?").otherwise(F.coalesce("staged", F.lit(" "))).alias("staged"), F.when(F.col("untracked"), "?").otherwise(F.coalesce("unstaged", F.lit(" "))).alias("unstaged"))


def merge_verdicts(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, verdict, base, ours, theirs``: what a merge does with every path."""
    t = three_way(keys, base=base, ours=ours, theirs=theirs)
    b, o, e = F.col("base"), F.col("ours"), F.col("theirs")
    verdict = (
        F.when(same(o, e), F.when(o.isNull(), "gone").otherwise("same"))
        .when(same(b, o), F.when(e.isNull(), "deleted-by-theirs").otherwise("theirs"))
        .when(same(b, e), F.when(o.isNull(), "deleted-by-ours").otherwise("ours"))
        .when(e.isNull(), "ours-kept-silently")
        .otherwise("conflict")
    )
    return t.withColumn("verdict", verdict)


def merged(verdicts: DataFrame, path: str = "path") -> DataFrame:
    """Resulting entries; a conflict keeps ours and adds theirs beside it."""
    p, o, e, v = F.col(path), F.col("ours"), F.col("theirs"), F.col("verdict")
    entry = lambda name, blocks, clash: F.struct(name.alias("path"), blocks.alias("blocks"), F.lit(clash).alias("conflict"))
    rows = (
        F.when(v == "theirs", F.array(entry(p, e, False)))
        .when(v.isin("same", "ours", "ours-kept-silently"), F.array(entry(p, o, False)))
        .when((v == "conflict") & o.isNotNull(), F.array(entry(p, o, True), entry(F.concat(p, F.lit(".MERGE_THEIRS")), e, True)))
        .when(v == "conflict", F.array(entry(F.concat(p, F.lit(".MERGE_THEIRS")), e, True)))
    )
    keep = [c for c in verdicts.columns if c not in (path, "base", "ours", "theirs", "verdict")]
    return verdicts.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` wins by key, other rows of ``old`` stay (index merge)."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def pathspec(entries: DataFrame, spec: str) -> DataFrame:
    """``.`` takes all, else a glob on the base name or a prefix of the path."""
    from strataforge.functions.glob import glob_regex
    from strataforge.functions.strings import base_name

    if spec == ".":
        return entries
    test = F.col("path").startswith(spec)
    if (found := glob_regex(spec)) is not None and "/" not in spec:
        test = test | base_name(F.col("path")).rlike(found)
    return entries.where(test)
