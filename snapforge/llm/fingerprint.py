"""Similarity digests from improbable features, held in chained Bloom filters.

A feature is a window of ``WIDTH`` bytes. Windows are ranked by how rare their entropy is: the
entropies (in bins) of all windows of all documents are counted, and the rarer a bin, the less its
rank. Among each ``SPAN`` consecutive windows the one of least rank (the first on ties) gets a
point; windows with ``POINTS`` or more are the selected features. They are inserted, in order, into Bloom
filters of ``FILTER`` bytes with ``HASHES`` bits each, at most ``PER_FILTER`` features in one; the next
features open the next filter. Windows and spans are short, for texts of any size, so that an edited copy of a
text of a line still shares some. A text of under ``WIDTH`` bytes is one feature itself.

Two digests are compared filter by filter: the bits two filters share, less what chance gives,
over the most they could share; each filter of the shorter digest takes its best match, and the
likeness is their mean (of both digests' filters if they have as many, so the order of the two never matters). Equal digests have likeness 1, an empty text's digest 0 to any other.

For the query's neighbours, documents are dealt in id order into ranges with explicit cuts (Spark's
``percentile_approx`` over the ids), sorted, and streamed with one row of lookahead; the first
document of each range also goes, flagged, to the end of the range before. So each text
is shuffled once. Rows with one id (or none) are ordered by a hash of their text; if they hold several ranges'
share of the rows, they are dealt to as many ranges by that hash. Rows alike in both are interchangeable
and stay in one range.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import runs, shuffle_partitions, text_docs

WIDTH = 8
BINS = 512
SPAN = 8
POINTS = 2
FILTER = 256
HASHES = 5
PER_FILTER = 160
#: Texts are worked on in blocks of so many windows, with their neighbourhood.
BLOCK = 1 << 18
#: Shorter texts are worked on together, so many bytes at once.
TOGETHER = 1 << 17
#: Windows of a lower entropy (a bin) tell nothing: long runs of a few bytes.
LOW = BINS // 8
#: Share of the room between chance and full overlap that counts as no likeness.
CUT = 0.3
#: Ranges of ids per shuffle partition.
SPLIT = 8
#: Where rows without an id are dealt.
NO_ID = -(1 << 63)

_SCALE = 1 << 20


@functools.lru_cache(maxsize=4)
def _weights(width: int) -> tuple[np.ndarray, np.ndarray]:
    """c * log2(c) of each count c, and what the c-th occurrence adds to it."""
    c = np.arange(1, width + 1)
    weight = np.concatenate(([0], np.rint(c * np.log2(c) * _SCALE).astype(np.int64)))
    return weight, np.concatenate(([0], np.diff(weight)))


def entropy_bins(x: np.ndarray, width: int = 64) -> np.ndarray:
    """Bin of the byte entropy of each window of ``x`` (uint8); exact integers, so blocks don't matter."""
    n = len(x) - width + 1
    weight, delta = _weights(width)
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    ahead = np.ones(len(x), dtype=np.uint8)  # occurrences of x[i] in the window that begins at i
    behind = np.ones(len(x), dtype=np.uint8)  # ... and in the window that ends at i
    for k in range(1, width):
        same = (x[:-k] == x[k:]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    total = np.empty(n, dtype=np.int64)
    total[0] = weight[np.bincount(x[:width], minlength=1)].sum()
    np.cumsum(delta[behind[width:]] - delta[ahead[: n - 1]], out=total[1:])
    total[1:] += total[0]
    most = weight[width]  # one byte only: entropy 0
    return np.minimum((most - total) * BINS // most, BINS - 1)


def ranks_of(histogram: np.ndarray) -> np.ndarray:
    """Rank of each bin: rare bins first, ties by bin; bins of low entropy have the last rank of all."""
    rank = np.empty(BINS, dtype=np.int64)
    rank[np.lexsort((np.arange(BINS), histogram))] = np.arange(BINS)
    rank[:LOW] = BINS
    return rank


def _selected(x: np.ndarray, rank: np.ndarray, begin: int = 0) -> np.ndarray:
    """Where the selected features of ``x`` at or after ``begin`` begin."""
    n = len(x) - WIDTH + 1
    need = min(POINTS, max(1, n - SPAN + 1))
    out = [np.zeros(0, dtype=np.int64)]
    for at in range(begin, n, BLOCK):
        lo, hi = max(0, at - SPAN + 1), min(n, at + BLOCK + SPAN - 1)
        r = rank[entropy_bins(x[lo : hi + WIDTH - 1], WIDTH)]
        least = (r << 32) | np.arange(len(r))
        width = 1
        while width < min(SPAN, len(r)):
            step = min(width, min(SPAN, len(r)) - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        best = least[(least >> 32) < BINS] & 0xFFFFFFFF
        here = np.flatnonzero(np.bincount(best, minlength=len(r)) >= need) + lo
        out.append(here[(here >= at) & (here < at + BLOCK)])
    return np.concatenate(out)


def _selected_many(texts: list[bytes], begins: list[int], rank: np.ndarray) -> list[np.ndarray]:
    """``_selected`` of each text; texts of usual length are worked on together."""
    out = [np.zeros(0, dtype=np.int64)] * len(texts)
    usual, size = [], 0
    for i, (t, begin) in enumerate(zip(texts, begins, strict=True)):
        lo = max(0, begin - SPAN + 1)
        if len(t) - lo < WIDTH + SPAN + POINTS or len(t) - lo > BLOCK:
            out[i] = _selected(np.frombuffer(t, dtype=np.uint8), rank, begin)
            continue
        usual.append((i, lo, begin))
        size += len(t) - lo
        if size >= TOGETHER:
            _together(texts, usual, rank, out)
            usual, size = [], 0
    _together(texts, usual, rank, out)
    return out


def _together(texts: list[bytes], usual: list[tuple[int, int, int]], rank: np.ndarray, out: list[np.ndarray]) -> None:
    if not usual:
        return
    parts = [texts[i][lo:] for i, lo, _ in usual]
    x = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    r = rank[entropy_bins(x, WIDTH)]
    least = (r << 32) | np.arange(len(r))
    width = 1
    while width < SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    within = np.zeros(len(least), dtype=bool)  # spans that lie in one text
    for p, end in zip(parts, ends.tolist(), strict=True):
        within[end - len(p) : end - WIDTH - SPAN + 2] = True
    best = least[within]
    best = best[(best >> 32) < BINS] & 0xFFFFFFFF
    here = np.flatnonzero(np.bincount(best, minlength=len(r)) >= POINTS)
    cuts = np.searchsorted(here, np.concatenate(([0], ends)))
    for (i, lo, begin), p, end, a, b in zip(usual, parts, ends.tolist(), cuts[:-1], cuts[1:], strict=True):
        at = here[a:b] - (end - len(p)) + lo
        out[i] = at[at >= begin]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _filters(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, WIDTH)[at]).view(np.uint64)
    h = np.full(len(at), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(words.shape[1]):
        h = _mix(h ^ words[:, k])
    bits = np.zeros((-(-len(at) // PER_FILTER), FILTER * 8), dtype=bool)
    row = np.arange(len(at)) // PER_FILTER
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k)) % np.uint64(FILTER * 8)] = True
    return np.packbits(bits, axis=1)


def digests(texts: list[bytes], rank: np.ndarray, known: list[tuple[int, np.ndarray]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its filters, as rows of ``FILTER`` bytes (none for an empty text), and its features' places.

    ``known``: so many of a text's first bytes are those of a text with these features; only what
    the other bytes can change is worked out.
    """
    # features before that place depend on known bytes only
    safe = [n - WIDTH - SPAN + 2 for n, _ in known] if known else [0] * len(texts)
    safe = [s if s > 2 * SPAN else 0 for s in safe]
    found = _selected_many(texts, safe, rank)
    out = []
    for i, (text, begin, at) in enumerate(zip(texts, safe, found, strict=True)):
        none = np.zeros(0, dtype=np.int64)
        if begin:
            at = np.concatenate((known[i][1][known[i][1] < begin], at))
        if not text:
            out.append((np.zeros((0, FILTER), dtype=np.uint8), none))
        elif len(text) >= WIDTH and len(at):
            out.append((_filters(np.frombuffer(text, dtype=np.uint8), at), at))
        else:  # a short text, or no window of it tells anything: the text as a whole is the feature
            whole = text.ljust(WIDTH, b"\0") if len(text) < WIDTH else hashlib.sha512(text).digest()
            out.append((_filters(np.frombuffer(whole, dtype=np.uint8), np.zeros(1, dtype=np.int64)), none))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; see the module's docstring."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    in_a, in_b = (np.bitwise_count(x.view(np.uint64)).sum(axis=1, dtype=np.int64) for x in (a, b))
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    for i, f in enumerate(a):
        both = np.bitwise_count(f.view(np.uint64) & b.view(np.uint64)).sum(axis=1, dtype=np.int64)
        most = np.minimum(in_a[i], in_b)
        chance = in_a[i] * in_b / (FILTER * 8)
        floor = chance + CUT * (most - chance)
        room = np.maximum(most - floor, 1e-9)
        scores = np.clip((both - floor) / room, 0, 1)
        best_a[i] = scores.max()
        np.maximum(best_b, scores, out=best_b)
    if len(a) < len(b):
        return min(1.0, float(np.mean(best_a)))
    return min(1.0, float(np.mean(sorted([*best_a, *best_b]))))  # sorted: the same sum in either order


def range_of(ids: np.ndarray, hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Range of each row, rising with (id, hash). A cut that comes several times splits its id's rows by their hash."""
    below = np.searchsorted(cuts, ids, side="left")
    times = (np.searchsorted(cuts, ids, side="right") - below).astype(np.uint64)
    high = (hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # in the order of the signed hashes
    return below + np.where(times > 0, ((high * times) >> np.uint64(32)).astype(np.int64) + 1, 0)


def text_of(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def filters_of(text: str) -> np.ndarray:
    """The filters of a digest string, to be compared with ``likeness``."""
    return np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, FILTER)


def entropy_histogram(docs: DataFrame) -> np.ndarray:
    """Windows of all documents by entropy bin: ``BINS`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for _, some in runs((t.as_buffer().to_pybytes() for t in batch.column(0)), TOGETHER):
                x = np.frombuffer(b"".join(some), dtype=np.uint8)
                whole = np.ones(len(x), dtype=bool)  # windows that lie in one text
                for end in np.cumsum([len(t) for t in some]).tolist():
                    whole[max(0, end - WIDTH + 1) : end] = False
                for at in range(0, len(x) - WIDTH + 1, BLOCK):
                    bins = entropy_bins(x[at : at + BLOCK + WIDTH - 1], WIDTH)
                    total += np.bincount(bins[whole[at : at + len(bins)]], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(total)], names=["bin", "n"])

    found = text_docs(docs).select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    out = np.zeros(BINS, dtype=np.int64)
    for r in found.collect():  # BINS rows
        out[r["bin"]] = r["n"]
    return out


def fingerprinted(docs: DataFrame, histogram: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by as much of the beginning of the next document. A
    null text counts as empty. A lone document is its own next; null ids come first.
    """
    rank = ranks_of(entropy_histogram(docs) if histogram is None else histogram)
    n = shuffle_partitions(docs.sparkSession)
    rows = text_docs(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))
    share = [i / (n * SPLIT) for i in range(1, n * SPLIT)]
    filled = F.coalesce("doc_id", F.lit(NO_ID))
    cuts = rows.agg(F.percentile_approx(filled, share, 100 * n * SPLIT)).first()[0]  # n * SPLIT numbers
    cuts = np.array(sorted(cuts or []), dtype=np.int64)

    def part_of(batch: pa.RecordBatch, h: int) -> np.ndarray:
        """The range of each row; column ``h`` has the text's hash."""
        return range_of(np.asarray(batch.column(0).fill_null(NO_ID)), np.asarray(batch.column(h)), cuts)

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple] = {}
        for batch in batches:
            ids = batch.column(0)
            for part, i, h in zip(part_of(batch, 1).tolist(), ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = (i is not None, i or 0, h)
                if part not in least or key < least[part]:
                    least[part] = key
        cols = [[p, k[1] if k[0] else None, k[2]] for p, k in least.items()]
        kinds = [pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[j] for c in cols], t) for j, t in enumerate(kinds)], names=["part", "doc_id", "h"]
        )

    # the first row of each range: one per range
    heads = (
        rows.select("doc_id", "h").mapInArrow(first_rows, "part int, doc_id long, h long")
        .groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("r")).select("part", "r.doc_id", "r.h").collect()
    )
    order = sorted(r["part"] for r in heads)
    before = dict(zip(order, order[-1:] + order[:-1], strict=True))
    head = {(r["doc_id"], r["h"]): before[r["part"]] for r in heads}
    head_hashes = np.array(sorted({h for _, h in head}), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(part_of(batch, 2), pa.int32())
            plain = pa.array(np.zeros(len(batch), dtype=np.int8))
            yield pa.RecordBatch.from_arrays([*batch.columns, part, plain], names=["doc_id", "text", "h", "part", "ghost"])
            maybe = np.flatnonzero(np.isin(np.asarray(batch.column(2)), head_hashes)).tolist()
            maybe = [(i, head.get((batch.column(0)[i].as_py(), batch.column(2)[i].as_py()))) for i in maybe]
            found = [(i, p) for i, p in maybe if p is not None]
            if found:
                copy = batch.take(pa.array([i for i, _ in found]))
                yield pa.RecordBatch.from_arrays(
                    [*copy.columns, pa.array([p for _, p in found], pa.int32()), pa.array([1] * len(found), pa.int8())],
                    names=["doc_id", "text", "h", "part", "ghost"],
                )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: part, id, text, filters, places, whether a copy
        for batch in batches:
            first = 0
            for first, some in runs(t.as_buffer().to_pybytes() for t in batch.column(1)):
                ids, texts, parts, ghosts = (batch.column(i).slice(first, len(some)).to_pylist() for i in (0, 1, 3, 4))
                rows = [(p, i, t, *d, g) for p, i, t, d, g in zip(parts, ids, texts, digests(some, rank), ghosts, strict=True)]
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                yield frame(rows_of([(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[5]]))

    def rows_of(pairs: list[tuple]) -> list[tuple]:
        kept = [a[2][: len(a[2]) - len(a[2]) // 4].encode() for a, _ in pairs]
        edited = [k + b[2][: len(a[2]) // 4].encode() for k, (a, b) in zip(kept, pairs, strict=True)]
        new = digests(edited, rank, [(len(k), a[4]) for k, (a, _) in zip(kept, pairs, strict=True)])
        return [
            (
                a[1], len(a[2]), hashlib.sha256(e).hexdigest(), text_of(a[3]), text_of(d),
                likeness(a[3], d), likeness(a[3], b[3]),
            )
            for (a, b), e, (d, _) in zip(pairs, edited, new, strict=True)
        ]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def frame(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return (
        rows.mapInArrow(deal, "doc_id long, text string, h long, part int, ghost byte")
        .repartition(n, "part")
        .sortWithinPartitions("part", "ghost", "doc_id", "h")
        .mapInArrow(
            each,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double",
        )
    )
