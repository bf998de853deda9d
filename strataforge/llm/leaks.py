"""Evaluation texts inside training texts: suffix arrays over shards.

Every task builds suffix arrays over shards of its documents' words and binary
searches the suffixes of the evaluation items in them, those that begin with the same
MIN_WORDS words at once. That gives the documents and items that share a run; per such
pair the longest verbatim match and its place follow. No pair of places is listed, so
repeated words cost no more than others. Nothing is shuffled but the matches. The
items are the small, fixed side; they are shipped in blocks of proven size, so
that any number of them works.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row that make a leak.
MIN_WORDS = 12
#: Words of documents per suffix array; characters of items per block.
SHARD_WORDS, BLOCK_CHARS = 1_000_000, 16_000_000

_invisible = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]+")
_word = regex.compile(r"[\p{L}\p{N}]+")
_ascii_word = regex.compile(r"[a-z0-9]+")

MATCH = "doc_id bigint, item_id bigint, n_words int, doc_word int, item_word int"


def words_of(text: str | None) -> list[str]:
    """Words for comparison: runs of letters and digits.

    Case, punctuation, white space, invisible format characters and the Unicode
    form (compatibility, composed) make no difference. Null has none.
    """
    if not text:
        return []
    if text.isascii():
        return _ascii_word.findall(text.lower())
    shape = unicodedata.normalize("NFKC", _invisible.sub("", text))
    shape = unicodedata.normalize("NFKC", _invisible.sub("", shape.casefold()))
    return _word.findall(shape)


class Items:
    """Word numbers of a block of items; 0 separates, unknown words have none."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.numbers: dict[str, int] = {}
        flat, item, place = [], [], []
        self.longest = MIN_WORDS
        for item_id, text in rows:
            words = words_of(text)
            self.longest = max(self.longest, len(words))
            for i, w in enumerate(words):
                flat.append(self.numbers.setdefault(w, len(self.numbers) + 1))
                item.append(item_id)
                place.append(i)
            flat.append(-1)  # differs from the documents' separator: never equal
            item.append(-1)
            place.append(-1)
        self.flat = np.array([-1, *flat], dtype=np.int64)
        self.item = np.array([-1, *item], dtype=np.int64)
        self.place = np.array([-1, *place], dtype=np.int64)
        # suffixes long enough: no separator within MIN_WORDS
        ends = np.flatnonzero(self.flat < 0)
        room = ends[np.searchsorted(ends, np.arange(len(self.flat)))] - np.arange(len(self.flat)) if len(ends) else np.zeros(0)
        starts = np.flatnonzero((self.flat > 0) & (room >= MIN_WORDS))
        # suffixes by their first MIN_WORDS words: one stands for all, with the items that hold it
        grams = self.flat[starts[:, None] + np.arange(MIN_WORDS)]
        _, first, kind = np.unique(grams, axis=0, return_index=True, return_inverse=True) if len(starts) else (None, starts, starts)
        self.starts = starts[first]
        held = np.unique(np.stack([kind.ravel(), self.item[starts]], axis=1), axis=0)
        self.holders, self.holder_at = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(self.starts) + 1))
        self.words: dict[int, np.ndarray] = {}
        for i, a, b in self._spans():  # texts of one id follow each other, 0 between
            self.words[i] = np.concatenate([*([self.words[i], [0]] if i in self.words else []), self.flat[a:b]])

    def _spans(self) -> Iterator[tuple[int, int, int]]:
        ends = np.flatnonzero(self.flat < 0)
        for a, b in zip(ends[:-1] + 1, ends[1:]):
            if b > a:
                yield int(self.item[a]), int(a), int(b)


def suffix_array(numbers: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in order of the suffixes' first ``depth`` (or more) words.

    Prefix doubling; positions of separators (0) are left out.
    """
    rank = numbers.copy()
    k, n = 1, len(numbers)
    base = max(n, int(numbers.max(initial=0))) + 2
    order = np.flatnonzero(numbers > 0)
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] if k < n else 0
        keys = rank[order] * base + second[order]
        by = np.argsort(keys, kind="stable")
        order, keys = order[by], keys[by]
        fresh = np.cumsum(np.r_[1, keys[1:] != keys[:-1]]) if len(keys) else keys
        k *= 2
        if k >= depth or k >= n or (len(fresh) and fresh[-1] == len(fresh)):
            return order
        rank = np.zeros(n, dtype=np.int64)
        rank[order] = fresh


def _bound(docs: np.ndarray, suffixes: np.ndarray, items: Items, upper: bool) -> np.ndarray:
    """Binary search of every item suffix by its first MIN_WORDS words."""
    low, high = np.zeros(len(items.starts), dtype=np.int64), np.full(len(items.starts), len(suffixes), dtype=np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        at, want = suffixes[middle], items.starts[open_]
        sign = np.zeros(len(open_), dtype=np.int64)
        same = np.arange(len(open_))
        for t in range(MIN_WORDS):
            d = np.sign(docs[at[same] + t] - items.flat[want[same] + t])
            sign[same] = d
            same = same[d == 0]
            if not same.size:
                break
        right = sign <= 0 if upper else sign < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
    return low


def longest_run(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Length and places (document, item; the first ones) of the longest common run.

    Ranks of runs of 2^k words by doubling name the runs of any length, a binary
    search over lengths finds the longest; near-linear whatever repeats.
    """
    # unknown words (0) and the ends equal nothing
    both = np.concatenate([doc, [0], item, [0]])
    lone = np.flatnonzero(both <= 0)
    both = both.copy()
    both[lone] = both.max(initial=0) + 1 + np.arange(len(lone))
    ranks, width = [both], 1
    while 2 * width <= min(len(doc), len(item)):
        last = ranks[-1]
        pairs = last[:-width] * (int(last.max()) + 1) + last[width:]
        ranks.append(np.unique(pairs, return_inverse=True)[1])
        width *= 2

    def shared(n: int) -> tuple[int, int] | None:
        k = n.bit_length() - 1
        rank, size = ranks[k], len(both) - n + 1
        names = rank[:size] * (int(rank.max()) + 1) + rank[n - (1 << k) : n - (1 << k) + size]
        mine, theirs = names[: len(doc) - n + 1], names[len(doc) + 1 : len(doc) + 1 + len(item) - n + 1]
        hit = np.flatnonzero(np.isin(mine, theirs))
        return (int(hit[0]), int(np.flatnonzero(theirs == mine[hit[0]])[0])) if len(hit) else None

    low, high, best = 0, min(len(doc), len(item)), None
    while low < high:
        middle = (low + high + 1) // 2
        if (found := shared(middle)) is None:
            high = middle - 1
        else:
            low, best = middle, found
    return (low, *(best or (0, 0)))


def search(ids: list, texts: list, items: Items) -> pd.DataFrame:
    """Longest verbatim matches between a shard of documents and all items."""
    get = items.numbers.get
    flat: list[int] = [0]
    owner, first = [], []
    for n, text in enumerate(texts):
        words = words_of(text)
        if len(words) < MIN_WORDS:
            continue
        first.append(len(flat))
        owner.append(n)
        flat.extend([get(w, 0) for w in words])
        flat.append(0)
    docs = np.array(flat + [0] * (items.longest + 1), dtype=np.int64)
    columns = ["doc_id", "item_id", "n_words", "doc_word", "item_word"]
    if not owner or not len(items.starts):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    suffixes = suffix_array(docs, MIN_WORDS)
    low, high = _bound(docs, suffixes, items, False), _bound(docs, suffixes, items, True)
    count = high - low
    # every place of a document has one kind of run, so this is no longer than the shard
    kind = np.repeat(np.arange(len(count)), count)
    at = suffixes[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    first_at = np.array([*first, len(flat)])
    pairs = np.unique(np.stack([np.searchsorted(first_at, at, side="right") - 1, kind], axis=1), axis=0)
    found: dict[int, set[int]] = {}
    for doc, k in pairs.tolist():
        found.setdefault(doc, set()).update(items.holders[items.holder_at[k] : items.holder_at[k + 1]].tolist())
    rows = []
    for doc, held in found.items():
        words = docs[first_at[doc] : first_at[doc + 1] - 1]
        rows += [(ids[owner[doc]], i, *longest_run(words, items.words[i])) for i in sorted(held)]
    return pd.DataFrame(rows, columns=columns)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most about BLOCK_CHARS characters."""
    rows = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per (document, item) that share a run of MIN_WORDS words: the longest run.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``; other columns are
    ignored. Returns ``doc_id, item_id, n_words, doc_word, item_word`` (length of
    the longest run and its first word in both texts). Every item that holds a
    run is a case. Null and empty texts match nothing, repeated documents and
    items count once, no items or no documents give no rows.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = None
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(Items(block))

        def scan(batches: Iterable[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids: list = []
            texts: list = []
            size = 0
            for batch in batches:
                for i, t in zip(batch["doc_id"], batch["text"]):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size >= 6 * SHARD_WORDS:
                        yield search(ids, texts, shared.value)
                        ids, texts, size = [], [], 0
            if ids:
                yield search(ids, texts, shared.value)

        part = docs.mapInPandas(scan, MATCH)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.n_words").alias("n_words"), (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a passage of ``items``; all columns and repeated rows kept.

    Documents without an id are searched under a hash of their text.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    clean = named.join(leaks(named, items).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    lone = docs.where(F.col("doc_id").isNull()).withColumn("_hash", F.xxhash64("text"))
    hit = leaks(lone.select(F.col("_hash").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_hash")).distinct()
    return clean.unionByName(lone.join(hit, "_hash", "left_anti").select(*docs.columns))
