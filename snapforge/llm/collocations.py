"""Phrase collocations: contiguous phrases of 2 to 5 words, counted by direct-address tiling.

Texts, A-Z lower-cased, are split at ``.,;:!?`` and line ends into pieces, and pieces at blanks and tabs into words;
everything is per language (null: ``und``). Words that occur ``least`` times are numbered by falling frequency,
and each text becomes a sequence of numbers with gaps. Neighbouring numbers are pairs. A task cuts the pairs into tiles of ``TILE`` by
``TILE`` by their two numbers' places: the tiles that the numbers' frequencies make dense (the first few, as numbers
fall in frequency) are counted by one ``bincount`` straight into an array, the others as sorted coordinates with counts.
Spark adds the tasks' counts up. Frequent pairs are numbered anew by frequency, and the sequence of pairs, one for each place, is counted in
the same way: two neighbouring phrases of k words, which overlap by k - 1, are one of k + 1. A phrase is frequent only
if both are, so nothing is lost. A score's integer arithmetic is that of decimals of 38 digits.

Bounds: a task holds the distinct words or pairs of about ``RUN`` words at most, then hands them on. The dense tiles
are at most ``2 * RUN / TILE**2``, whatever the data. Numbers are given in Spark (dense ranks, no window over one task) and broadcast in
blocks of ``BLOCK`` entries and ``BLOCK_BYTES``; a vocabulary or list of pairs beyond one block takes one more pass a block,
each written, with nothing dropped. Frequent words and pairs reach the driver only as the block that it broadcasts. A hot phrase is added up map-side first.

Null and empty texts have no words. Rows alike count each. Empty tables give no rows. Extra columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import quoted, shuffle_partitions, written
from snapforge.operators.keys import assign_row_keys

TILE_BITS = 9
TILE = 1 << TILE_BITS
RUN = 4_000_000
#: entries, and bytes of words, of one broadcast
BLOCK = 1_000_000
BLOCK_BYTES = 32_000_000
#: bytes of text whose words are counted before they are handed on
COUNTED_BYTES = 64_000_000
#: numbers in a row of a sequence (a longer stretch without a gap stays whole, as in its text)
ROW = 250_000
_CUTS = b".,;:!?\n\v\f\r"
#: stands for a cut and between texts; no lower-cased text has it
_CUT = b"A"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _CUTS + b"\t", bytes(range(97, 123)) + _CUT * len(_CUTS) + b" ")
_BETWEEN = b" " + _CUT + b" "


def words_of(text: bytes) -> list[bytes]:
    """The words, and a ``_CUT`` for each cut."""
    return text.translate(_TABLE).replace(_CUT, _BETWEEN).split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(quoted("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(quoted("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


# --- words -------------------------------------------------------------------------
def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) for every word, and for each language a row whose word is null: the number of all its words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                counts.setdefault(lang, Counter()).update(words_of(raw))
                size += len(raw)
                if size > COUNTED_BYTES:
                    yield from _counted(counts)
                    counts, size = {}, 0
        yield from _counted(counts)

    return texts.mapInArrow(each, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _counted(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, words in counts.items():
        words.pop(_CUT, None)
        names, found = [None, *words], [words.total(), *words.values()]
        for at in range(0, len(names), 100_000):
            some = names[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(found[at : at + 100_000], pa.int64())],
                names=["lang", "word", "f"],
            )


# --- numbers by frequency, broadcast in blocks ---------------------------------------
def ranked(rows: DataFrame, *ties: str) -> DataFrame:
    """``rows`` with ``id`` 0, 1, ... by falling ``f``, then ``ties``; written."""
    return written(assign_row_keys(rows, start=0, order=[F.col("f").desc(), *map(F.col, ties)], key_col="id"))


def blocks_of(numbered: DataFrame, size: Column, columns: list[str]) -> Iterator[pa.Table]:
    """``columns`` of the rows, by id, in blocks of ``BLOCK`` rows and ``BLOCK_BYTES`` of ``size`` (and one group of rows); one at least."""
    step = max(1, BLOCK // 64)
    groups = numbered.groupBy(F.floor(F.col("id") / step).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).orderBy("g")
    lo = n = b = 0
    for g in groups.toLocalIterator():  # some bytes for each 15,625 rows
        if n and (n + g["n"] > BLOCK or b + g["b"] > BLOCK_BYTES):
            yield _block(numbered, lo, g["g"] * step, columns)
            lo, n, b = g["g"] * step, 0, 0
        n, b = n + g["n"], b + g["b"]
    yield _block(numbered, lo, None, columns)


def _block(numbered: DataFrame, lo: int, hi: int | None, columns: list[str]) -> pa.Table:
    some = numbered.where((F.col("id") >= lo) & (F.col("id") < hi)) if hi is not None else numbered.where(F.col("id") >= lo)
    return some.select("id", *columns).toArrow()


def in_blocks(rows: DataFrame, blocks: Iterator, one_pass: Callable[[DataFrame, object, bool, bool], DataFrame]) -> DataFrame:
    """``one_pass(rows, block, is the first, is the last)`` for each block, each result written."""
    block, first = next(blocks), True
    while block is not None:
        after = next(blocks, None)
        rows = written(one_pass(rows, block, first, after is None))
        block, first = after, False
    return rows


# --- sequences ---------------------------------------------------------------------
def squeezed(ids: np.ndarray) -> np.ndarray:
    """The sequence with its numbers that have no neighbour, and gaps (-1) behind a gap, left out."""
    known = np.concatenate(([False], ids >= 0, [False]))
    kept = known[1:-1] & (known[:-2] | known[2:])
    ids = np.where(kept, ids, -1)
    return ids[kept | np.concatenate(([True], kept[:-1]))] if len(ids) else ids


def _sequence(ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (ids): the sequence, cut at gaps into rows of ``ROW`` numbers and on to the next gap."""
    gaps = np.flatnonzero(ids < 0)
    at = 0
    while at < len(ids):
        gap = np.searchsorted(gaps, at + ROW)
        to = int(gaps[gap]) + 1 if gap < len(gaps) else len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([ids[at:to].astype(np.int32).tobytes()], pa.binary())], names=["ids"])
        at = to


def word_sequences(texts: DataFrame, numbered: DataFrame) -> DataFrame:
    """Rows (ids) with the numbers of the texts' words, -1 for others, at cuts and between texts."""
    blocks = blocks_of(numbered, F.length("word") + F.length("lang"), ["lang", "word"])

    def one_pass(rows: DataFrame, block: pa.Table, first: bool, last: bool) -> DataFrame:
        words: dict[str, dict[bytes, int]] = {}
        for i, lang, word in zip(*(block.column(c).to_pylist() for c in ("id", "lang", "word")), strict=True):
            words.setdefault(lang, {})[word] = i
        shared = rows.sparkSession.sparkContext.broadcast(words)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                pending, size = [], 0
                out = []
                earlier = repeat(None) if first else batch.column(2)
                for lang, text, before in zip(batch.column(0).to_pylist(), batch.column(1), earlier, strict=False):
                    found = words_of(text.as_buffer().to_pybytes())
                    ids = np.fromiter(map(known.get(lang, {}).get, found, repeat(-1)), np.int32, len(found))
                    if before is not None:
                        ids = np.maximum(ids, np.frombuffer(before.as_buffer(), np.int32))
                    if not last:
                        out.append(ids.tobytes())
                        continue
                    pending += [squeezed(ids), np.array([-1], np.int32)]
                    size += len(ids)
                    if size > RUN:
                        yield from _sequence(np.concatenate(pending))
                        pending, size = [], 0
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["lang", "text", "ids"])
                elif pending:
                    yield from _sequence(np.concatenate(pending))

        return rows.mapInArrow(each, "ids binary" if last else "lang string, text binary, ids binary")

    return in_blocks(texts, blocks, one_pass)


def codes(ids: np.ndarray) -> np.ndarray:
    """Each two neighbours as one number, -1 where one of them is a gap."""
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), a << 32 | b, -1)


def pair_sequences(sequences: DataFrame, numbered: DataFrame) -> DataFrame:
    """The sequence of the numbers of neighbouring pairs, -1 where the pair has none."""
    blocks = blocks_of(numbered, F.lit(16), ["code"])

    def one_pass(rows: DataFrame, block: pa.Table, first: bool, last: bool) -> DataFrame:
        keys, ids = block.column("code").to_numpy(), block.column("id").to_numpy().astype(np.int32)
        order = np.argsort(keys)
        shared = rows.sparkSession.sparkContext.broadcast((keys[order], ids[order]))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, numbers = shared.value
            for batch in batches:
                out = []
                earlier = repeat(None) if first else batch.column(1)
                for row, before in zip(batch.column(0), earlier, strict=False):
                    pairs = codes(np.frombuffer(row.as_buffer(), np.int32))
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                        found = np.where(keys[at] == pairs, numbers[at], np.int32(-1))
                    else:
                        found = np.full(len(pairs), -1, np.int32)
                    if before is not None:
                        found = np.maximum(found, np.frombuffer(before.as_buffer(), np.int32))
                    if last:
                        yield from _sequence(squeezed(found))
                    else:
                        out.append(found.tobytes())
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["ids", "found"])

        return rows.mapInArrow(each, "ids binary" if last else "ids binary, found binary")

    return in_blocks(sequences, blocks, one_pass)


# --- pairs -------------------------------------------------------------------------
def dense_tiles(numbered: DataFrame) -> np.ndarray:
    """[i, j]: a number for tile (i, j) if a run of ``RUN`` neighbours drawn by the numbers' frequencies would put a pair in
    half of its cells, else -1. A side's share must be at least that of a tile, so at most ``2 * RUN / TILE**2`` rows count."""
    share = TILE * TILE / (2 * RUN)
    mass = numbered.groupBy(F.floor(F.col("id") / TILE).cast("int").alias("i")).agg(F.sum("f").cast("double").alias("m"))
    total = numbered.select(F.sum("f").cast("double")).first()[0] or 1.0
    found = {r["i"]: r["m"] / total for r in mass.where(F.col("m") >= share * total).collect()}  # fewer than 1 / share rows
    m = np.array([found.get(i, 0.0) for i in range(max(found, default=-1) + 1)])
    dense = np.outer(m, m) >= share
    out = np.full(dense.shape, -1, np.int64)
    out[dense] = np.arange(dense.sum())
    return out


class PairCounts:
    """Counts of pairs: dense tiles in one array, the rest as sorted codes with their counts."""

    def __init__(self, tiles: np.ndarray) -> None:
        self.tiles = tiles
        self.cells = np.zeros(int(tiles.max(initial=-1) + 1) << (2 * TILE_BITS), np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, pairs: np.ndarray) -> None:
        pairs = pairs[pairs >= 0]
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        if len(self.cells):
            side = len(self.tiles)
            i, j = a >> TILE_BITS, b >> TILE_BITS
            inside = np.flatnonzero((i < side) & (j < side))
            tile = self.tiles[i[inside], j[inside]]
            inside, tile = inside[tile >= 0], tile[tile >= 0]
            cell = (tile << (2 * TILE_BITS)) | ((a[inside] & (TILE - 1)) << TILE_BITS) | (b[inside] & (TILE - 1))
            self.cells += np.bincount(cell, minlength=len(self.cells))
            rest = np.ones(len(pairs), bool)
            rest[inside] = False
            pairs = pairs[rest]
        some, counts = np.unique(pairs, return_counts=True)
        self.parts.append((some, counts))
        self.size += len(some)
        if self.size > RUN:
            self.merge()

    def merge(self) -> None:
        all_codes, all_counts = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(all_codes, kind="stable")
        some, first = np.unique(all_codes[order], return_index=True)
        self.parts = [(some, np.add.reduceat(all_counts[order], first) if len(some) else all_counts)]
        self.size = len(some)

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(codes, counts) of all that was counted."""
        if self.parts:
            self.merge()
            yield self.parts[0]
        at = np.flatnonzero(self.cells)
        place = np.argwhere(self.tiles >= 0)[at >> (2 * TILE_BITS)].reshape(-1, 2)
        a = place[:, 0] << TILE_BITS | (at >> TILE_BITS) & (TILE - 1)
        b = place[:, 1] << TILE_BITS | at & (TILE - 1)
        yield a << 32 | b, self.cells[at]
        self.cells[:] = 0
        self.parts, self.size = [], 0


def pair_counts(sequences: DataFrame, numbered: DataFrame) -> DataFrame:
    """(code, f) for every pair of neighbours; ``numbered`` has the frequencies of the sequences' numbers."""
    shared = sequences.sparkSession.sparkContext.broadcast(dense_tiles(numbered))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts(shared.value)
        pending, size = [], 0
        for batch in batches:
            for row in batch.column(0):
                pending.append(codes(np.frombuffer(row.as_buffer(), np.int32)))
                size += len(pending[-1])
                if size > RUN:
                    counts.add(np.concatenate(pending))
                    pending, size = [], 0
                    if counts.size > 2 * RUN:
                        yield from _rows(counts)
        if pending:
            counts.add(np.concatenate(pending))
        yield from _rows(counts)

    return sequences.mapInArrow(each, "code long, f long").groupBy("code").agg(F.sum("f").alias("f"))


def _rows(counts: PairCounts) -> Iterator[pa.RecordBatch]:
    for some, found in counts.take():
        for at in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[at : at + 100_000]), pa.array(found[at : at + 100_000])], names=["code", "f"])


# --- phrases -----------------------------------------------------------------------
def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n): the words of each language; and for 1 to ``longest`` words the phrases of ``least`` occurrences: id, lang, phrase (binary), f, starts and ends
    (the frequencies of its first and last 1, 2, ... words), code (the ids of its first and last words but one) and longer
    (the greatest frequency of a phrase one word longer that holds it)."""
    texts = _texts(docs)
    counts = written(word_counts(texts).where((F.col("f") >= least) | F.col("word").isNull()))
    n = counts.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    numbered = ranked(counts.where(F.col("word").isNotNull()), "lang", "word")
    sequences = word_sequences(texts, numbered)
    levels = [numbered.select("id", "lang", F.col("word").alias("phrase"), F.lit(None).cast("long").alias("code"), "f", F.array("f").alias("starts"), F.array("f").alias("ends"))]
    for words in range(2, longest + 1):
        frequent = pair_counts(sequences, levels[-1]).where(F.col("f") >= least)
        numbered = ranked(frequent, "code")
        levels.append(_phrases(numbered, levels[-1]))
        if words < longest:
            sequences = pair_sequences(sequences, numbered)
    out = []
    for level, more in zip(levels, [*levels[1:], None], strict=True):
        if more is None:
            out.append(level.withColumn("longer", F.lit(0).cast("long")))
            continue
        first, second = _halves("code")
        held = more.select(F.explode(F.array(first, second)).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
        out.append(level.join(held, "id", "left").withColumn("longer", F.coalesce("longer", F.lit(0))))
    return n, out


def _halves(code: str) -> tuple[Column, Column]:
    return F.shiftright(code, 32), F.col(code).bitwiseAND(F.lit(0xFFFFFFFF))


def _phrases(numbered: DataFrame, parts: DataFrame) -> DataFrame:
    """The phrases of numbered pairs (id, code, f) of ``parts``; written."""
    first, second = _halves("code")
    a = parts.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), F.col("starts").alias("before"))
    last_word = F.substring_index(F.col("phrase").cast("string"), " ", -1).cast("binary")
    b = parts.select(F.col("id").alias("b"), last_word.alias("tail"), F.col("ends").alias("behind"))
    rows = numbered.withColumns({"a": first, "b": second}).join(a, "a").join(b, "b")
    return written(
        rows.select(
            "id", "lang", F.concat("head", F.lit(b" "), "tail").alias("phrase"), "code", "f",
            F.concat("before", F.array("f")).alias("starts"), F.concat("behind", F.array("f")).alias("ends"),
        )
    )


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000) -> DataFrame:
    """Each language's best phrases (all with ``top`` None): lang, rank, phrase, a, l, r, n, score, words.

    Of the cuts of a phrase into two parts the one with the least score floor(1000 * a * n / (l * r)) counts, of several the
    first. A phrase whose words stand in a longer frequent phrase just as often as anywhere (f at least as
    great) is left out; it is enough to look at those one word longer, as frequencies only fall with length."""
    n, levels = frequent_phrases(docs, least, longest)
    found = None
    for words, level in enumerate(levels[1:], 2):
        cuts = [F.struct(_score(k, words).alias("score"), F.lit(k).alias("k"), F.get("starts", F.lit(k - 1)).alias("l"),
                         F.get("ends", F.lit(words - k - 1)).alias("r")) for k in range(1, words)]
        best = level.where(F.col("longer") < F.col("f")).join(n, "lang").withColumn("cut", F.array_min(F.array(*cuts)))
        rows = best.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", F.lit(words).alias("words"))
        found = rows if found is None else found.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # the best of each part of a language first, so that no task sorts a whole language
        part = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
        found = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
        found = found.where(F.col("rank") <= top).drop("part", "rank")
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words")


def _score(k: int, words: int) -> Column:
    wide = "cast({} as decimal(38,0))".format
    return F.expr(f"({wide('1000')} * {wide('f')} * {wide('n')}) div ({wide(f'get(starts, {k - 1})')} * {wide(f'get(ends, {words - k - 1})')})")
