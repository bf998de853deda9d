"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Corpus-level merge replay: the different pre-tokens ("words") of the corpus are
collected once, and per shard of words an inverted index from token pair to word
positions applies every merge in rank order. A merge visits only the positions
the index names and re-indexes only the two touched neighbours. A word that
occurs in a billion documents is merged once.

The texts are split once: documents are handled in chunks of bounded text size, each
with a dictionary of its different words, and a document becomes the numbers of its
words there. The dictionaries are joined with the words' ids, words of very many
chunks by broadcast, and the chunk's documents are assembled from numbers alone.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.session import cut

try:
    from tokenizers.pre_tokenizers import ByteLevel
except ImportError:
    ByteLevel = None

#: Where the vocabulary lies unless a path is given.
VOCABULARY = os.environ.get("STRATAFORGE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
#: Characters of text per chunk of documents; rows per chunk.
CHUNK_CHARS, CHUNK_ROWS = 2_000_000, 8192
#: Characters of words that one replay holds in memory.
REPLAY_CHARS = 1_500_000

#: Words of more chunks than this may be broadcast, and how many such words at most.
HEAVY_CHUNKS, HEAVY_WORDS = 64, 20_000

INDEXED = "chunk bigint, is_doc boolean, doc_id bigint, at array<int>, n int, word string"


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte.

    Printable Latin-1 bytes stand for themselves, the others, in order, for the
    code points from 256 on.
    """
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Byte ids and merges of a vocabulary file, small and picklable."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        self.bytes = np.array([ids[x] for x in byte_letters()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)

    def ranks(self) -> dict[int, int]:
        """Pair, packed into one number, to its rank; made once per process."""
        if not hasattr(self, "_ranks"):
            self._ranks = {k: r for r, k in reversed(list(enumerate(((self.left << 32) | self.right).tolist())))}
        return self._ranks

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ranks"}


@functools.cache
def _splitter():
    if ByteLevel is None:
        raise RuntimeError("the library 'tokenizers' is needed to split texts as the vocabulary does")
    return ByteLevel(add_prefix_space=False)


def words_of(text: str) -> list[str]:
    """The pre-tokens of a text, in order; together they are the text."""
    return [text[a:b] for _, (a, b) in _splitter().pre_tokenize_str(text)]


def replay(words: list[str], merges: Merges) -> list[np.ndarray]:
    """Ids of every word: all merges applied in rank order over all words at once."""
    ranks, made, left, right = merges.ranks(), merges.made.tolist(), merges.left.tolist(), merges.right.tolist()
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum([len(b) for b in raw]) if raw else np.zeros(0, dtype=np.int64)
    flat = merges.bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    n = len(flat)
    token = flat.tolist()
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for e in ends.tolist():  # words end here: no pair crosses
        if e:
            after[e - 1] = -1
            if e < n:
                before[e] = -1

    index: dict[int, list[int]] = defaultdict(list)
    for i, j in enumerate(after):
        if j >= 0 and (r := ranks.get((token[i] << 32) | token[j])) is not None:
            index[r].append(i)
    waiting = list(index)
    heapq.heapify(waiting)
    while waiting:
        r = heapq.heappop(waiting)
        a, b, new = left[r], right[r], made[r]
        for i in sorted(index.pop(r, ())):
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue  # an earlier merge took a part
            k, p = after[j], before[i]
            token[i], token[j] = new, -1
            after[i] = k
            if k >= 0:
                before[k] = i
                if (q := ranks.get((new << 32) | token[k])) is not None:
                    if q not in index:
                        heapq.heappush(waiting, q)
                    index[q].append(i)
            if p >= 0 and (q := ranks.get((token[p] << 32) | new)) is not None:
                if q not in index:
                    heapq.heappush(waiting, q)
                index[q].append(p)
    out, kept = [], np.array(token, dtype=np.int64)
    for s, e in zip(np.r_[0, ends[:-1]] if len(ends) else [], ends):
        part = kept[s:e]
        out.append(part[part >= 0].astype(np.int32))
    return out


def _chunks(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Slices of the batches with the number of their chunk.

    Numbers are unique over partitions and the same each time a partition is read.
    """
    context = TaskContext.get()
    number, chars, rows = (context.partitionId() if context else 0) << 32, 0, 0
    for batch in batches:
        start = 0
        lengths = batch["text"].str.len().fillna(0).to_numpy()
        for i, n in enumerate(lengths):
            if rows and (chars + n > CHUNK_CHARS or rows >= CHUNK_ROWS):
                if i > start:
                    yield number, batch.iloc[start:i]
                number, chars, rows, start = number + 1, 0, 0, i
            chars += n
            rows += 1
        if start < len(batch):
            yield number, batch.iloc[start:]


def _indexed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as numbers of words, and the words of every chunk with their numbers."""
    columns = [c.split()[0] for c in INDEXED.split(", ")]

    def dictionary(number: int, seen: dict[str, int]) -> pd.DataFrame:
        return pd.DataFrame({"chunk": number, "is_doc": False, "doc_id": None, "at": None, "n": range(len(seen)), "word": list(seen)})[columns]

    current, seen = None, {}
    for number, rows in _chunks(batches):
        if number != current and seen:
            yield dictionary(current, seen)
            seen = {}
        current = number
        put = seen.setdefault
        at = [np.array([put(w, len(seen)) for w in words_of(t)], dtype=np.int32) if t else np.zeros(0, dtype=np.int32) for t in rows["text"]]
        yield pd.DataFrame({"chunk": number, "is_doc": True, "doc_id": rows["doc_id"], "at": at, "n": None, "word": None})[columns]
    if seen:
        yield dictionary(current, seen)


def _assemble(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Ids of every document of a chunk from the ids of its words."""
    by = np.argsort(words["n"].to_numpy(), kind="stable")
    ids = words["ids"].to_numpy()[by]
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    flat, starts = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32), np.cumsum(sizes) - sizes
    at = np.concatenate([*docs["at"], np.zeros(0, np.int32)]).astype(np.int64)
    each = sizes[at]
    ends = np.cumsum(each)
    out = flat[np.repeat(starts[at] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
    places = np.r_[0, ends][np.cumsum([len(x) for x in docs["at"]])]
    return pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "ids": np.split(out, places[:-1])})


def encode(docs: DataFrame, merges: Merges) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) of every row of ``docs`` (``doc_id, text``).

    Null and empty texts give an empty list. Strings that look like special
    tokens are ordinary text. Repeated rows, null ids and an empty table are
    fine: one output row per input row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(merges)

    def replay_shard(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done() -> pd.DataFrame:
            return pd.DataFrame({"word": held, "chunks": counts, "ids": replay(held, shared.value)})

        held: list[str] = []
        counts: list[int] = []
        chars = 0
        for batch in batches:
            for word, n in zip(batch["word"], batch["chunks"]):
                held.append(word)
                counts.append(n)
                chars += len(word)
                if chars >= REPLAY_CHARS:
                    yield done()
                    held, counts, chars = [], [], 0
        if held:
            yield done()

    table = cut(docs.select("doc_id", "text").mapInPandas(_indexed, INDEXED), "indexed")
    words = table.where(~F.col("is_doc")).select(F.col("chunk").alias("home"), "n", "word")
    encoded = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("chunks")).mapInPandas(replay_shard, "word string, chunks bigint, ids array<int>"), "encoded")
    # words that hold more than a HEAVY_WORDS-th part of all entries: fewer than HEAVY_WORDS
    least = max(HEAVY_CHUNKS, encoded.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0] // HEAVY_WORDS)
    heavy = encoded.where(F.col("chunks") > least).select("word", "ids")
    marked = words.join(F.broadcast(heavy), "word", "left")
    rest = marked.where(F.col("ids").isNull()).drop("ids").join(encoded.select("word", "ids"), "word")
    dictionary = marked.where(F.col("ids").isNotNull()).select("home", "n", "ids").unionByName(rest.select("home", "n", "ids"))
    texts = table.where(F.col("is_doc")).select("chunk", "doc_id", "at")
    return texts.groupBy("chunk").cogroup(dictionary.groupBy("home")).applyInPandas(_assemble, "doc_id bigint, ids array<int>")


def token_counts(encoded: DataFrame) -> DataFrame:
    """How often every id occurs: ``token_id, n``; partial counts before the shuffle."""
    return encoded.select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
