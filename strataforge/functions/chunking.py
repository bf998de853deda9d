"""Content-defined chunking and block hashes: the only kernels in Python.

The cut test of a gear hash modulo 2^k looks at the last k bytes only, so cut
candidates are found for a whole array at once and the greedy choice visits only
the few candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import xxhash
except ImportError:
    xxhash = None

#: Smallest and largest block, cut modulus (fixed values).
MIN_BLOCK, MAX_BLOCK, MODULUS = 2 << 20, 8 << 20, 4096
#: Words of the gear table that are filled; the rest are zero.
FILLED = 244

BLOCK = "path string, seq int, hash string, size bigint, offset bigint"


def _pi_words(n: int) -> list[int]:
    """The first ``n`` 32-bit words of the fraction of pi, by Machin's formula."""
    bits = 32 * n + 64
    one = 1 << bits

    def arctan(x: int) -> int:
        total = term = one // x
        k, sign = 3, -1
        while term:
            term //= x * x
            total += sign * (term // k)
            k, sign = k + 2, -sign
        return total

    pi = 4 * (4 * arctan(5) - arctan(239))
    fraction = pi - 3 * one
    return [(fraction >> (bits - 32 * (i + 1))) & 0xFFFFFFFF for i in range(n)]


@lru_cache
def gear() -> np.ndarray:
    return np.array(_pi_words(FILLED) + [0] * (256 - FILLED), dtype=np.uint32)


def cut_points(data: bytes, smallest: int = MIN_BLOCK, largest: int = MAX_BLOCK, modulus: int = MODULUS) -> list[int]:
    """Ends of the blocks of ``data``; none for no bytes.

    ``modulus`` is a power of two and ``smallest`` at least its logarithm.
    """
    window = modulus.bit_length() - 1
    if modulus != 1 << window or smallest < window:
        raise ValueError("modulus must be a power of two, smallest at least its logarithm")
    n = len(data)
    if n == 0:
        return []
    words = gear()[np.frombuffer(data, dtype=np.uint8)]
    rolling = np.zeros(n, dtype=np.uint32)
    for k in range(min(window, n)):
        rolling[k:] += words[: n - k] << np.uint32(k)
    # fewer than `window` bytes before: those places are below the smallest block
    candidates = np.flatnonzero((rolling & np.uint32(modulus - 1)) == 0) + 1
    ends, start = [], 0
    while start < n:
        i = np.searchsorted(candidates, start + smallest)
        end = int(candidates[i]) if i < len(candidates) else n
        end = min(end, start + largest, n)
        ends.append(end)
        start = end
    return ends


def block_hash(data: bytes) -> str:
    """XXH3-128 in lower-case hex.

    Without the library nothing else may take its place: a store with ids of two
    kinds would be damaged on every other machine.
    """
    if xxhash is None:
        raise RuntimeError("the library 'xxhash' is needed for block ids")
    return xxhash.xxh3_128_hexdigest(data)


def split_files(files: DataFrame, smallest: int = MIN_BLOCK, largest: int = MAX_BLOCK, modulus: int = MODULUS) -> DataFrame:
    """Blocks of files (``path, content binary``): ``path, seq, hash, size, offset``.

    Null and empty contents have no blocks. Map-only; files are never shuffled.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                start = 0
                for seq, end in enumerate(cut_points(bytes(data), smallest, largest, modulus) if data else []):
                    rows.append((path, seq, block_hash(bytes(data[start:end])), end - start, start))
                    start = end
            yield pd.DataFrame(rows, columns=["path", "seq", "hash", "size", "offset"])

    return files.select("path", "content").mapInPandas(run, BLOCK)


@F.pandas_udf(T.StringType())
def xxh3(values: pd.Series) -> pd.Series:
    """Block hash of strings (as UTF-8) or binary values; null for null."""
    return values.map(lambda v: None if v is None else block_hash(v.encode() if isinstance(v, str) else bytes(v)))


