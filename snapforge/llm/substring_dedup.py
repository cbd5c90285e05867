"""Removing passages that occur elsewhere in the corpus, by suffix automata of reference shards.

A window is ``window`` consecutive words of one document. Every word covered by a window whose word
sequence starts anywhere else too, in the same document or another, is removed. Windows are
judged on the input.

The reference is the corpus itself, so it grows with the input and its automata cannot be broadcast to all
documents: that would be the work of every pair. Instead windows and reference are sharded alike.
A window's anchor is the least hash of the word ``ANCHOR``-grams in it; equal windows have equal anchors, so
a shard by anchor holds all occurrences of its windows.

1. Documents are dealt once into groups by a hash. In a group, each maximal run of windows
   with one anchor is a segment (its windows' words). A group sends each anchor once to the anchor's
   shard, and gets back those that occur elsewhere too; no other can hold a repeated window.
2. Segments of these anchors, alike ones of a group merged with a count, go compressed to the
   shard. So a passage that a third of the corpus shares reaches its shard once per group, not once per
   document. For each anchor a suffix automaton of its segments (weighted by their counts) is built,
   and the segments are streamed through it for matching statistics: where the longest match that
   occurs at least twice has ``window`` words or more, the window that ends there occurs elsewhere.
3. Each group that holds such a segment gets the segment's hash and the mask of its repeated
   windows, and judges its documents. The three steps read one and the same text shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import WordTable, mixed, powers, quoted, runs, shuffle_partitions, tablewise, window_hashes

WINDOW = 35
ANCHOR = 12
#: Windows in a segment at most: their mask is one 64-bit number.
SEGMENT = 64
#: Groups and shards per shuffle partition: a group or shard is that part of a partition.
SPLIT = 2
#: A group's texts are handed to numpy in runs of about so many bytes.
TOGETHER = 1_000_000


class Segments:
    """The segments of several texts: the text, first word, windows, anchor and hash of each, and whether its
    anchor occurs more than once in these texts."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.words = words = WordTable(texts)
        n = len(words.hash) - window + 1
        k = min(ANCHOR, window)
        grams = window_hashes(words.hash, k)
        least, span = grams, 1
        while span < window - k + 1 and n > 0:  # least of window - k + 1 neighbours, doubling
            step = min(span, window - k + 1 - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        doc = words.doc[: max(n, 0)]
        valid = doc == words.doc[window - 1 :]
        if n < 1 or not valid.any():
            self.doc = self.first = self.count = np.zeros(0, dtype=np.int64)
            self.anchor = self.hash = np.zeros(0, dtype=np.uint64)
            self.again = np.zeros(0, dtype=bool)
            return
        new = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
        begin = np.concatenate(([0], np.flatnonzero(new) + 1))
        size = np.diff(np.concatenate((begin, [n])))
        begin, size = begin[valid[begin]], size[valid[begin]]
        pieces = -(-size // SEGMENT)  # long runs of one anchor, in repetitive text, are cut
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.repeat(begin + size, pieces)
        begin = np.repeat(begin, pieces) + inner * SEGMENT
        self.doc, self.first, self.count = words.doc[begin], begin, np.minimum(end - begin, SEGMENT)
        self.anchor = least[begin]
        in_order = np.sort(grams)
        twice = in_order[1:][in_order[1:] == in_order[:-1]]
        self.again = np.isin(self.anchor, twice)
        power, back = powers(len(words.hash) + 1)
        sums = np.zeros(len(words.hash) + 1, dtype=np.uint64)
        np.cumsum(words.hash * power[:-1], out=sums[1:])
        after = begin + self.count + window - 1
        self.hash = mixed((sums[after] - sums[begin]) * back[begin] + mixed(self.count.astype(np.uint64)))

    def text(self, i: int, window: int) -> bytes:
        w = self.words
        return w.raw[w.first[self.first[i]] : w.last[self.first[i] + self.count[i] + window - 2]]


def _packed(anchor: np.ndarray, hashes: np.ndarray, count: np.ndarray, texts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, texts), dtype=np.uint32, count=len(texts))
    head = np.uint32(len(texts)).tobytes()
    raw = head + anchor.tobytes() + hashes.tobytes() + count.astype(np.uint32).tobytes() + sizes.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw + b"".join(texts))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    anchor = np.frombuffer(raw, np.uint64, n, 4)
    hashes = np.frombuffer(raw, np.uint64, n, 4 + 8 * n)
    count = np.frombuffer(raw, np.uint32, n, 4 + 16 * n)
    sizes = np.frombuffer(raw, np.uint32, n, 4 + 20 * n)
    return anchor, hashes, count, sizes, raw[4 + 24 * n :]


class Automaton:
    """A suffix automaton of weighted word sequences."""

    def __init__(self, segments: list[list[bytes]], weights: list[int]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.weight = [-1], [0], [0]
        for words, weight in zip(segments, weights, strict=True):
            last = 0
            for w in words:
                last = self._extend(last, w)
                self.weight[last] += weight
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.weight[self.link[v]] += self.weight[v]

    def _copy(self, p: int, w: bytes, q: int) -> int:
        """The state of p + w, split off the longer strings of q."""
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.weight.append(0)
        new = len(self.len) - 1
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier segment has this prefix already
            return q if self.len[q] == self.len[last] + 1 else self._copy(last, w, q)
        cur = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        self.weight.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._copy(p, w, q)
        return cur

    def repeated(self, words: list[bytes], window: int) -> int:
        """Matching statistics of ``words``: bit i is set if the window from word i occurs at least twice."""
        mask, state, size = 0, 0, 0
        nxt, link, length, weight = self.next, self.link, self.len, self.weight
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            while state and length[link[state]] >= window:  # only the last `window` words matter
                state = link[state]
                size = length[state]
            if size >= window and weight[state] >= 2:
                mask |= 1 << (i - window + 1)
        return mask


def _judged(anchor: np.ndarray, weight: np.ndarray, words_of, window: int) -> Iterator[tuple[int, int]]:
    """(index, mask of its repeated windows) of each distinct segment that has any."""
    order = np.argsort(anchor, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(anchor[order])) + 1):
        segments = [words_of(i) for i in group.tolist()]
        automaton = Automaton(segments, weight[group].tolist())
        for i, words in zip(group.tolist(), segments, strict=True):
            mask = automaton.repeated(words, window)
            if mask:
                yield i, mask


def _by_shard(anchor: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in ``anchor``) of each shard that has any."""
    shard = (anchor >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if part.size:
            yield int(shard[part[0]]), part


def _messages(rows: list[tuple[int, int, bytes]], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _texts(table: pa.Table) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in table.column("text")]


def _blobs(table: pa.Table, name: str, dtype=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer().to_pybytes(), dtype) for b in table.column(name)]


def _anchors(window: int, shards: int):
    """Documents of a group -> its distinct anchors for each shard, those that the group has twice first."""

    def each(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        found, more = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, some in runs(_texts(table), TOGETHER):
            s = Segments(some, window)
            distinct, count = np.unique(s.anchor, return_counts=True)
            found.append(distinct)
            more += [distinct[count > 1], s.anchor[s.again]]
        distinct, count = np.unique(np.concatenate(found), return_counts=True)
        more = np.union1d(distinct[count > 1], np.concatenate(more))
        once = np.setdiff1d(distinct, more, assume_unique=True)
        rows = {}
        for k, anchors in enumerate((more, once)):
            for shard, part in _by_shard(anchors, shards):
                rows.setdefault(shard, [b"", b""])[k] = anchors[part].tobytes()
        return _messages(
            [(shard, grp, np.uint64(len(a) // 8).tobytes() + a + b) for shard, (a, b) in rows.items()],
            ["shard", "grp", "blob"],
        )

    return each


def _repeated_anchors(table: pa.Table) -> pa.Table:
    """The groups' anchors in a shard -> for each group its anchors that occur more than once in the corpus."""
    parts = _blobs(table, "blob")
    anchor = np.concatenate([p[1:] for p in parts])
    more = np.concatenate([np.arange(len(p) - 1) < int(p[0]) for p in parts])
    grp = np.repeat(np.asarray(table.column("grp")), [len(p) - 1 for p in parts])
    _, which, count = np.unique(anchor, return_inverse=True, return_counts=True)
    again = (count > 1) | (np.bincount(which, weights=more) > 0)
    hit = np.flatnonzero(again[which])
    hit = hit[np.argsort(grp[hit], kind="stable")]
    rows = [
        (int(grp[part[0]]), 0, anchor[part].tobytes())
        for part in np.split(hit, np.flatnonzero(np.diff(grp[hit])) + 1) if part.size
    ]
    return _messages(rows, ["grp", "none", "found"])


def _segments(window: int, shards: int):
    """Documents of a group and its repeated anchors -> for each shard the distinct segments with these."""

    def each(table: pa.Table, found: pa.Table) -> pa.Table:
        wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *_blobs(found, "found")]))
        if not table.num_rows or not len(wanted):
            return _messages([], ["shard", "grp", "blob"])
        grp = table.column("grp")[0].as_py()
        parts, texts, counts = [], [], []
        merged: dict[int, int] = {}  # hash of a segment -> its place; alike ones of all runs become one
        for _, some in runs(_texts(table), TOGETHER):
            s = Segments(some, window)
            at = np.minimum(np.searchsorted(wanted, s.anchor), len(wanted) - 1)
            mine = np.flatnonzero(wanted[at] == s.anchor)
            hashes, first, count = np.unique(s.hash[mine], return_index=True, return_counts=True)
            first = mine[first]
            for i, h, n in zip(first.tolist(), hashes.tolist(), count.tolist(), strict=True):
                if h not in merged:
                    merged[h] = len(texts)
                    texts.append(s.text(i, window))
                    counts.append(0)
                counts[merged[h]] += n
            parts.append((s.anchor[first], hashes))
        anchor, hashes = (np.concatenate([p[i] for p in parts]) for i in range(2))
        # texts and counts are by the first place of each hash in the runs, and so are these
        first = np.sort(np.unique(hashes, return_index=True)[1])
        anchor, hashes, count = anchor[first], hashes[first], np.array(counts, dtype=np.uint32)
        return _messages(
            [
                (shard, grp, _packed(anchor[part], hashes[part], count[part], [texts[i] for i in part.tolist()]))
                for shard, part in _by_shard(anchor, shards)
            ],
            ["shard", "grp", "blob"],
        )

    return each


def _shard(window: int):
    def each(table: pa.Table) -> pa.Table:
        """The blobs of a shard -> for each group, hashes and masks of its segments with repeated windows."""
        parts = [_unpacked(b.as_buffer().to_pybytes()) for b in table.column("blob")]
        grp = np.repeat(np.asarray(table.column("grp")), [len(p[0]) for p in parts])
        anchor, hashes, count, sizes = (np.concatenate([p[i] for p in parts]) for i in range(4))
        text = b"".join(p[4] for p in parts)
        del parts
        end = np.cumsum(sizes, dtype=np.int64)
        # alike segments of several groups become one, its weight the sum of theirs
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        weight = np.bincount(which, weights=count).astype(np.int64)
        words_of = lambda i: text[end[first[i]] - sizes[first[i]] : end[first[i]]].split()
        mask = np.zeros(len(first), dtype=np.uint64)
        for i, m in _judged(anchor[first], weight, words_of, window):
            mask[i] = m
        of_row = mask[which]
        hit = np.flatnonzero(of_row)
        hit = hit[np.argsort(grp[hit], kind="stable")]
        rows = [
            (int(grp[part[0]]), 0, hashes[part].tobytes() + of_row[part].tobytes())
            for part in np.split(hit, np.flatnonzero(np.diff(grp[hit])) + 1) if part.size
        ]
        return _messages(rows, ["grp", "none", "found"])

    return each


def removed_words(s: Segments, masks: dict[int, int], window: int) -> np.ndarray:
    """For each word of the texts, whether a repeated window covers it."""
    n = len(s.words.hash)
    cover = np.zeros(n + 1, dtype=np.int32)
    hit = [(f, masks[h]) for f, h in zip(s.first.tolist(), s.hash.tolist(), strict=True) if h in masks] if masks else []
    if hit:
        bits = np.array([m for _, m in hit], dtype="<u8").view(np.uint8).reshape(-1, 8)
        row, at = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
        starts = np.array([f for f, _ in hit], dtype=np.int64)[row] + at
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
    return np.cumsum(cover[:n]) > 0


def _judged_texts(texts: list[bytes], masks: dict[int, int], window: int) -> Iterator[tuple[int, np.ndarray, list[bytes] | None]]:
    """(words, whether each is removed, kept words or None if none is removed) of each text."""
    for _, some in runs(texts, TOGETHER):
        s = Segments(some, window)
        gone = removed_words(s, masks, window)
        for a, b, t in zip(s.words.words_before[:-1].tolist(), s.words.words_before[1:].tolist(), some, strict=True):
            own = gone[a:b]
            yield b - a, own, [w for w, g in zip(t.split(), own.tolist(), strict=True) if not g] if own.any() else None


def _masks(table: pa.Table) -> dict[int, int]:
    out: dict[int, int] = {}
    for pair in _blobs(table, "found"):
        out.update(zip(pair[: len(pair) // 2].tolist(), pair[len(pair) // 2 :].tolist(), strict=True))
    return out


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (its text column named text) dealt into groups ``grp`` by a hash of the whole row."""
    n = shuffle_partitions(docs.sparkSession)
    plain = [quoted(c) for c, t in docs.dtypes if "map<" not in t]
    return docs.withColumn("grp", F.pmod(F.xxhash64(*plain), F.lit(n * SPLIT)).cast("int")).repartition(n, "grp"), n


def _meet(dealt: DataFrame, n: int, window: int, each, schema: str) -> DataFrame:
    # every step takes the groups with all their columns, so that Spark reuses the one exchange of the texts
    shards, groups = n * SPLIT, dealt.groupBy("grp")
    to_anchors, to_segments, to_masks = _anchors(window, shards), _segments(window, shards), _shard(window)
    to_shard, to_group = "shard int, grp int, blob binary", "grp int, none int, found binary"
    anchors = groups.applyInArrow(lambda t: tablewise(to_anchors, t), to_shard)
    repeated = anchors.groupBy("shard").applyInArrow(lambda t: tablewise(_repeated_anchors, t), to_group)
    segments = groups.cogroup(repeated.groupBy("grp")).applyInArrow(lambda t, found: tablewise(to_segments, t, found), to_shard)
    masks = segments.groupBy("shard").applyInArrow(lambda t: tablewise(to_masks, t), to_group)
    return groups.cogroup(masks.groupBy("grp")).applyInArrow(lambda t, found: tablewise(each, t, found), schema)


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (word ranges removed).

    ``kept_sha256`` is of the kept words joined by one space. A null text has no words. A row that
    is repeated counts as occurring again, like any other document with that text.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>"
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def each(table: pa.Table, found: pa.Table) -> pa.Table:
        masks = _masks(found)
        out: list[list] = [[], [], [], [], []]
        texts = _texts(table)
        judged = _judged_texts(texts, masks, window)
        for doc_id, t, (n, gone, kept) in zip(table.column("doc_id").to_pylist(), texts, judged, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))) if kept is not None else gone[:0]
            row = (
                doc_id, n, int(gone.sum()), hashlib.sha256(b" ".join(t.split() if kept is None else kept)).hexdigest(),
                [{"first": int(a), "last": int(b) - 1} for a, b in edge.reshape(-1, 2)],
            )
            for c, v in zip(out, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
        return pa.table([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=names)

    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))
    dealt, n = _dealt(rows)
    return _meet(dealt, n, window, each, schema)


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all its columns, without the repeated passages.

    A text that loses words becomes its kept words joined by one space (``n_chars``, if there is such
    a column, is its new length); any other text is left as it is, null included. No row is dropped: a
    document of which nothing is left has an empty text.
    """
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else -1
    rows = renamed.withColumnRenamed(f"c{at}", "text")

    def each(table: pa.Table, found: pa.Table) -> pa.Table:
        masks = _masks(found)
        texts, sizes = table.column("text").to_pylist(), {}
        for i, (_, _, kept) in enumerate(_judged_texts(_texts(table), masks, window)):
            if kept is not None:
                texts[i] = b" ".join(kept).decode()
                sizes[i] = len(texts[i])
        cols = [table.column(f"c{i}") if i != at else pa.array(texts, table.column("text").type) for i in range(len(names))]
        if chars >= 0 and sizes:
            old = cols[chars].to_pylist()
            cols[chars] = pa.array([sizes.get(i, v) for i, v in enumerate(old)], cols[chars].type)
        return pa.table(cols, names=[f"c{i}" for i in range(len(names))])

    dealt, n = _dealt(rows)
    return _meet(dealt, n, window, each, renamed.schema).toDF(*names)
