"""Packing documents into fixed-length token sequences: shortest-pack-first over the length histogram.

1. Each document is tokenised once, an end token is added, and it is cut into pieces of at most
   ``max_tokens`` tokens (full pieces, then one rest). The pieces are written to the shared folder.
2. Their length histogram (at most ``max_tokens`` rows, whatever the corpus size) goes to the
   driver. Lengths are placed longest first; each goes into the open packs with the most room
   left (the shortest packs), and only if none has room are new packs opened. What is kept is
   not packs but packing patterns with counts.
3. The patterns come back as slots (length, range of ranks, first sequence, offset); each piece
   has a rank among the pieces of its length and is joined to the slot that holds its rank.

Ranks are given within (length, salt) and shifted by the counts of the salts before, so a length
shared by a third of the corpus is ranked by many tasks.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import batchwise, runs, shuffle_partitions, text_docs, written

#: Trailing marks that the pre-tokenizer splits from the letters before them (no apostrophe).
MARKS = ".,;:!?|\"()[]-"
#: Of each memo; a worker keeps them from task to task. With fewer, the many distinct words push out the frequent ones.
MEMO_ENTRIES = 400_000
#: Words of more bytes are encoded anew each time: text without blanks can be one word of any length.
MEMO_WORD = 64


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """bytes of a text -> its token ids as little-endian uint32 bytes; made once per Python worker.

    The tokenizer never lets a token cross white space, so a text is encoded word by word from a
    bounded memo of words, each of bounded length. A word of Latin-1 letters with trailing marks is lower-cased and given
    to the BPE model directly (NFC and lower-casing are trivial there); any other word takes
    the whole tokenizer.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    simple = _simple_words(tok)

    class Memo(dict):
        def __missing__(self, word: bytes) -> bytes:
            s = word.decode("utf-8", "replace")
            core = s.rstrip(MARKS)
            if simple and core and core.isalpha() and max(core) < "Ā":
                ids = cores[core.lower()] + (marks[s[len(core):]] if len(core) < len(s) else b"")
            else:
                ids = whole(s)
            return kept(self, word, ids)

    class Cores(dict):
        def __missing__(self, core: str) -> bytes:
            chars = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_CHARS)
            ids = np.array([t.id for t in tok.model.tokenize(chars)], dtype="<u4").tobytes()
            return kept(self, core, ids)

    class Marks(dict):
        def __missing__(self, mark: str) -> bytes:
            return kept(self, mark, whole(mark))

    def kept(memo: dict, word, ids: bytes) -> bytes:
        if len(word) <= MEMO_WORD:
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            memo[word] = ids
        return ids

    def whole(s: str) -> bytes:
        return np.array(tok.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()

    memo, cores, marks = Memo(), Cores(), Marks()
    return lambda text: b"".join(map(memo.__getitem__, text.split()))


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level tokenizers use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_CHARS = _byte_chars()


def _simple_words(tok) -> bool:
    """Whether the tokenizer treats words of Latin-1 letters and marks as ``_encoder`` assumes."""
    for word in ("Word", "Été", "üBERªµ"):
        lower = word.lower().encode().decode("latin-1").translate(BYTE_CHARS)
        want = [t.id for t in tok.model.tokenize(lower)]
        tail = tok.encode("\".,", add_special_tokens=False).ids
        if tok.encode(word + "\".,", add_special_tokens=False).ids != want + tail:
            return False
        if tok.encode(f"{word} {word}", add_special_tokens=False).ids != want * 2:
            return False
    return True


def tokenized_pieces(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of the tokenised documents: doc_id, start, length, ids_crc32, doc_tokens[, ids].

    A null text counts as empty: its only token is the end token. ``with_ids`` adds the piece's
    ids as little-endian uint32 bytes.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids binary" if with_ids else ""
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for first, some in runs(t.as_buffer().to_pybytes() for t in texts):
                cols: list[list] = [[], [], [], [], [], []]
                for k, text in enumerate(some):
                    tokens = encode(text) + end
                    n = len(tokens) // 4
                    for start in range(0, n, max_tokens):
                        part = tokens[4 * start : 4 * (start + max_tokens)]
                        row = (ids[first + k], start, len(part) // 4, zlib.crc32(part), n, part)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=False)], names=names
                )

    return text_docs(docs).mapInArrow(batchwise(pieces), schema)


def packing_patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, copies), ...]) by shortest-pack-first over the histogram.

    There are at most three entries per length, so the result's size depends on ``size`` alone.
    """
    open_packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    spaces: list[int] = []  # heap of -space; a space is on it while open_packs has it

    def put(space: int, count: int, items: list[tuple[int, int]]) -> None:
        if space not in open_packs:
            open_packs[space] = []
            heapq.heappush(spaces, -space)
        open_packs[space].append((count, items))

    for length in sorted((x for x, c in histogram.items() if c), reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"length {length} is not within 1..{size}")
        left = histogram[length]
        while left:
            space = -spaces[0] if spaces else 0
            if space < length:  # no pack has room: open new ones, as full of this length as can be
                each = size // length
                if left >= each:
                    put(size - each * length, left // each, [(length, each)])
                if left % each:
                    put(size - left % each * length, 1, [(length, left % each)])
                break
            count, items = open_packs[space].pop()
            if not open_packs[space]:
                del open_packs[space]
                heapq.heappop(spaces)
            below = -spaces[0] if spaces else 0
            copies = max(1, min((space - below) // length, left // count)) if left >= count else 1
            taken = min(count, left)
            if taken < count:
                put(space, count - taken, items)
            put(space - copies * length, taken, [*items, (length, copies)])
            left -= taken * copies
    return [p for space in sorted(open_packs) for p in open_packs[space]]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, ...]]:
    """(length, first rank, rank after the last, first sequence, copies, offset) of each run in a pattern."""
    out, used, sequence = [], {}, 0
    for count, items in patterns:
        offset = 0
        for length, copies in items:
            first = used.get(length, 0)
            used[length] = first + count * copies
            out.append((length, first, used[length], sequence, copies, offset))
            offset += length * copies
        sequence += count
    return out


def pack(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece lies. See the module's docstring.

    ``pieces`` has doc_id, start and length (1..max_tokens) and any columns more, which come
    along; it is read twice, so pass a written table. Rows alike in every column are placed
    side by side like any others. No pieces give no rows.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # max_tokens rows at most
    slots = _slots(packing_patterns({r["length"]: r["n"] for r in counts}, max_tokens))
    salts = shuffle_partitions(spark)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = (
        salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("__n")
    )
    order = ["doc_id", "start", *(c for c in pieces.columns if c not in ("doc_id", "start", "length"))]
    ranked = (
        salted.withColumn("__row", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)))
        .join(before, ["length", "__salt"])
        .withColumn("__rank", F.col("__row") - 1 + F.col("__before"))
    )
    slot = spark.createDataFrame(
        slots, "__length long, __from long, __to long, __sequence long, __copies long, __offset long"
    )
    inside = F.col("__rank") - F.col("__from")
    return ranked.join(
        F.broadcast(slot),  # a few thousand patterns whatever the input
        (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")),
    ).select(
        *pieces.columns,
        (F.col("__sequence") + F.floor(inside / F.col("__copies"))).alias("sequence_id"),
        (F.col("__offset") + F.pmod(inside, F.col("__copies")) * F.col("length")).alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Documents tokenised, cut and packed: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset."""
    return pack(written(tokenized_pieces(docs, tokenizer, max_tokens, end_id, with_ids)), max_tokens)
