"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, and what it hits in the documents.

Words are runs of 0-9, a-z and non-ASCII characters of the text with A-Z lower-cased. A window is ``n``
consecutive words of a test item; an item of fewer words, but not none, is one window. Each document's words are
mapped to the numbers of the test words, its windows of known words are hashed and looked up, and a hit is verified
word by word. A word inside any occurrence of a window is hit; an item is hit if any of its windows occurs.

Bounds: test items are cut into pieces of ``PIECE`` words, which overlap by ``n - 1``, and pieces are
packed into blocks of ``BLOCK_BYTES``; the driver holds and broadcasts one block at a time. Test sets of one block (16 MB of
normalised text) take one pass over the documents; larger ones take a pass a block, each written, with nothing dropped.
No shuffle at all; a document's texts stay in one row.

Null and empty texts have no words, in documents and items. Rows alike are marked each. Items are told apart by
their id as a string; rows with one id are one item, and an item without an id hits words but is not listed. Tables
without rows give no hits. Other columns of the documents come along; the new ones get free names if need be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import fresh, mixed, quoted, runs, written

PIECE = 2000
BLOCK_BYTES = 16_000_000
_SEPARATORS = bytes(c for c in range(0x80) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: stands between two texts; no lower-cased text has it
_EDGE = b"A"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
MARKS = {"n_words": "long", "hits": "array<struct<first: long, last: long>>", "items": "array<string>"}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def test_pieces(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): the normalised words of each test item, joined by blanks, in pieces of ``PIECE`` words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - n + 1), PIECE - n + 1):
                    if words:
                        items.append(item)
                        pieces.append(b" ".join(words[at : at + PIECE]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], names=["item", "words"])

    rows = benchmark.select(
        quoted(id_col).cast("string").alias("item"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    )
    return rows.mapInArrow(each, "item string, words binary").distinct()


def blocks_of(pieces: DataFrame, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The pieces in blocks of ``limit`` bytes (and one piece); one block at least."""
    block, size = [], 0
    for item, words in pieces.toLocalIterator():
        block.append((item, bytes(words)))
        size += len(words)
        if size >= limit:
            yield block
            block, size = [], 0
    if block or size == 0:
        yield block


def _hashes(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each ``size`` consecutive numbers."""
    h = np.full(len(ids) - size + 1, seed, dtype=np.uint64)
    x = ids.astype(np.uint64)
    for i in range(size):
        h = h * _MUL + x[i : len(x) - size + 1 + i]
    return mixed(h)


class Windows:
    """The windows of one size of a block: sorted hashes, the words of each, and the items that have it."""

    def __init__(self, sequences: list[tuple[int, np.ndarray]], size: int) -> None:
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, size) for _, ids in sequences])
        owner = np.concatenate([np.full(len(ids) - size + 1, item) for item, ids in sequences])
        rows = np.ascontiguousarray(rows, dtype=np.int32)
        whole = rows.view(np.dtype((np.void, rows.dtype.itemsize * size))).ravel()
        _, first, window = np.unique(whole, return_index=True, return_inverse=True)
        rows = rows[first]
        for seed in range(100):  # distinct windows get distinct hashes
            h = np.full(len(rows), seed, dtype=np.uint64)
            for column in rows.T:
                h = h * _MUL + column.astype(np.uint64)
            h = mixed(h)
            if len(np.unique(h)) == len(h):
                break
        else:
            raise RuntimeError("no seed tells all windows apart")
        order = np.argsort(h)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[window], owner], axis=1), axis=0)
        self.size, self.seed, self.hashes, self.rows = size, seed, h[order], rows[order]
        self.items = pairs[:, 1]
        self.cuts = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        self.some = np.zeros(1 << _BITS, dtype=bool)
        self.some[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def found(self, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence; ``known`` counts the known words before each place."""
        none = np.zeros(0, dtype=np.int64)
        if len(ids) < self.size:
            return none, none
        h = _hashes(ids, self.size, self.seed)
        at = np.flatnonzero(self.some[(h >> np.uint64(64 - _BITS)).astype(np.int64)] & (known[self.size :] - known[: -self.size] == self.size))
        window = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        at, window = at[self.hashes[window] == h[at]], window[self.hashes[window] == h[at]]
        same = (ids[at[:, None] + np.arange(self.size)] == self.rows[window]).all(axis=1)  # the words themselves
        return at[same], window[same]


class Block:
    """What one broadcast holds: the test words by number, and the windows by size."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], n: int) -> None:
        self.items = sorted({item for item, _ in pieces if item is not None})
        number = {item: i for i, item in enumerate(self.items)}
        self.words: dict[bytes, int] = {}
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, words in pieces:
            ids = np.array([self.words.setdefault(w, len(self.words)) for w in words.split(b" ")], dtype=np.int32)
            by_size.setdefault(min(n, len(ids)), []).append((number.get(item, -1), ids))
        self.words[_EDGE] = -2
        self.windows = [Windows(sequences, size) for size, sequences in sorted(by_size.items())]

    def scan(self, texts: list[bytes], hits: list, items: list) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """n_words, hits and items of the texts; ``hits`` and ``items`` are those of earlier blocks."""
        words = (b" " + _EDGE + b" ").join([t.translate(_TABLE) for t in texts]).split()
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        edges = np.flatnonzero(ids == -2)
        begin = np.concatenate(([0], edges + 1))
        n_words = np.concatenate((edges, [len(ids)])) - begin
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        open_, close = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64)
        for doc, spans in enumerate(hits):
            for span in spans or ():
                open_[begin[doc] + span["first"]] += 1
                close[begin[doc] + span["last"] + 1] += 1
        named = [set(some or ()) for some in items]
        for windows in self.windows:
            at, window = windows.found(ids, known)
            open_ += np.bincount(at, minlength=len(open_))
            close += np.bincount(at + windows.size, minlength=len(close))
            doc = np.searchsorted(begin, at, side="right") - 1
            for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist():
                named[d].update(self.items[i] for i in windows.items[windows.cuts[w] : windows.cuts[w + 1]].tolist() if i >= 0)
        covered = np.cumsum(open_ - close)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).view(np.int8)))
        first, last = edge[::2], edge[1::2] - 1
        doc = np.searchsorted(begin, first, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(first - begin[doc], pa.int64()), pa.array(last - begin[doc], pa.int64())], ["first", "last"])
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
        return n_words, pa.ListArray.from_arrays(pa.array(cuts), spans), pa.array([sorted(s) for s in named], pa.list_(pa.string()))


def marked(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, list[str]]:
    """``docs`` (its columns ``keep``; all by default) with n_words, hits (the longest runs of words that are hit, by the
    numbers of their first and last word) and items (the ids hit, sorted), and the names that these three columns have."""
    keep = docs.columns if keep is None else keep
    names = [fresh(docs, name) for name in MARKS]
    body = fresh(docs, "body")
    rows = docs.select(*map(quoted, docs.columns), F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary").alias(body))
    before: list[str] = []
    blocks = blocks_of(test_pieces(benchmark, n, item_col, item_text_col), block_bytes)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        rows = _pass(rows, Block(block, n), body, before, names, docs.columns + [body] if after is not None else keep)
        if after is not None:
            rows = written(rows)
        before, block = names, after
    return rows, names


def _pass(rows: DataFrame, block: Block, body: str, before: list[str], names: list[str], keep: list[str]) -> DataFrame:
    """One pass over the documents with one block; ``before``: the marks of earlier passes are columns of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(body)]
            for first, some in runs(texts):
                part = batch.slice(first, len(some))
                earlier = [part.column(c).to_pylist() for c in before[1:]] or [[None] * len(some)] * 2
                n_words, hits, items = shared.value.scan(some, *earlier)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n_words, pa.int64()), hits, items], names=[*keep, *names])

    fields = ", ".join(f"{_tick(f.name)} {f.dataType.simpleString()}" for c in keep for f in rows.schema.fields if f.name == c)
    marks = ", ".join(f"{_tick(name)} {t}" for name, t in zip(names, MARKS.values(), strict=True))
    return rows.select(*[quoted(c) for c in rows.columns if c in {*keep, body, *before}]).mapInArrow(each, f"{fields}, {marks}" if fields else marks)


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(quoted(hits), F.lit(0).cast("long"), lambda total, h: total + h["last"] - h["first"] + 1)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the item ids, joined by commas),
    contaminated, hits, items."""
    rows, _ = marked(docs.select(quoted("doc_id").cast("long").alias("doc_id"), "text"), benchmark, n, keep=["doc_id"], block_bytes=block_bytes)
    return rows.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        "hits", "items",
    )


def without_spans(text: bytes, hits: list[dict[str, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each hit."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for hit in hits:
        out.append(text[at : places[hit["first"]][0]])
        at = places[hit["last"]][1]
    return b"".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "spans", text_col: str = "text") -> DataFrame:
    """``docs``, same columns, without its hit ``spans`` (texts are cut), or without the ``documents`` that have one."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    rows, (_, hits, _) = marked(docs, benchmark, n, text_col)
    names = docs.columns
    if remove == "documents":
        return rows.where(F.size(quoted(hits)) == 0).select(*map(quoted, docs.columns))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [
                None if t is None else without_spans(t.encode(), h).decode() if h else t
                for t, h in zip(batch.column(at).to_pylist(), batch.column(hits).to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    text_string = [quoted(c).cast("string").alias(c) if c == text_col else quoted(c) for c in names]
    kept = rows.select(*text_string, quoted(hits))
    return kept.mapInArrow(each, kept.drop(hits).schema)
