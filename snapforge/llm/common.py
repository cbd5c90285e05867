"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.session import checkpoint_dir

#: Texts are handed to numpy and to the tokenizers in runs of about so many characters.
RUN_CHARS = 4_000_000


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    Later steps see the same rows whichever executor is lost, and the work above is not redone.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id (as long) and the text (null: empty) of ``docs``, and nothing else."""
    return docs.select(
        quoted(id_col).cast("long").alias("doc_id"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key that equal rows share and that is never null: (id, 64-bit text hash).

    The hash only tells rows with one and the same id apart.
    """
    return F.struct(
        quoted(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(quoted(text_col).cast("string"), F.lit(""))).alias("h"),
    )


def runs(texts: Iterable[bytes], limit: int = RUN_CHARS) -> Iterator[tuple[int, list[bytes]]]:
    """(index of its first, texts) of consecutive texts of about ``limit`` bytes, so memory is bounded."""
    out: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        if out and size + len(t) > limit:
            yield first, out
            first, out, size = i, [], 0
        out.append(t)
        size += len(t)
    if out:
        yield first, out


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What Arrow and the C library keep of freed memory goes back to the system: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def batchwise(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``each``, a function of a task's batches; memory is given back when they are done."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from each(batches)
        finally:
            give_back()

    return task


def tablewise(each: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    """``each`` of a group's tables; memory is given back afterwards."""
    try:
        return each(*tables)
    finally:
        give_back()


_MUL = 0x9E3779B97F4A7C15
_BLOCK = 1 << 17


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed (one to one)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MUL)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of an odd number modulo 2**64, and of its inverse."""
    out = []
    for base in (_MUL, pow(_MUL, -1, 1 << 64)):
        a = np.full(n, base, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK + 2, 1 << (n - 1).bit_length())
    a, b = _powers(size)
    return a[:n], b[:n]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive numbers of ``h`` (uint64)."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(_MUL) + h[i : i + n]
    return mixed(out)


def _blank(separators: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


BLANK = _blank(b" \t\n\v\f\r")


class WordTable:
    """The words of several texts, by vectorised prefix hashes: no Python object per word.

    raw: the texts, joined by line breaks; first, last: each word's bytes ``raw[first:last]``; doc: the text it is
    in; hash: 64 bits of its bytes; words_before: for each text, the words of the texts before it.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b"\n".join(texts)
        x = np.frombuffer(self.raw, dtype=np.uint8)
        blank = BLANK[x]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        self.first, self.last = edge[::2], edge[1::2]
        self.hash = np.empty(len(self.first), dtype=np.uint64)
        size = (self.last - self.first).astype(np.uint64)
        at = 0
        while at < len(self.first):  # blocks of whole words
            lo = int(self.first[at])
            to = max(at + 1, int(np.searchsorted(self.last, lo + _BLOCK, side="right")))
            hi = int(self.last[to - 1])
            power, back = powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((x[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
            a, b = self.first[at:to] - lo, self.last[at:to] - lo
            self.hash[at:to] = (sums[b] - sums[a]) * back[a]
            at = to
        self.hash = mixed(self.hash + size * np.uint64(_MUL))
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.words_before = np.searchsorted(self.first, begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.words_before))
