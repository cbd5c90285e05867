"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

**Encoding.** A token sequence is the BPE encoding of its bytes exactly if each neighbouring pair
is: merging the bytes of the two gives the two back. So every prefix of a text has one
encoding, that of some shorter prefix plus one token that fits the token before it. A
(nondeterministic) transducer can hence read bytes and keep, for each place where a token may
have begun, the encoding up to there; its hypotheses are the places whose bytes since then
begin some token. ``Transducer`` determinises it as it goes: a state is the tuple of live
hypotheses (trie node, last token before it), and a step is looked up in the state's table and
worked out only the first time. Its output is the last token of the encoding so far; tokens
through which all live hypotheses go are emitted at a pre-token's end, and every ``LOOKAHEAD``
bytes within a longer one. The tables are bounded: when full, they start anew.

The words of a run of texts that the memo lacks go through the transducer side by side, one byte of each at a
time: numpy looks their steps up in a hash table (``_Steps``), and only steps not there are taken from the states.

**Decoding.** ``decode_stream`` feeds the bytes of each run of ids to an incremental UTF-8
state machine, which holds back the bytes of a character cut by a token or run boundary.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from snapforge.llm.common import runs, text_docs

STATES = 350_000
FITS = 1_000_000
LOOKAHEAD = 512
#: entries of each of the two generations of the memo of words; that of other pre-tokens has a quarter
MEMO_ENTRIES = 500_000
MEMO_CHARS = 64
#: words worked out side by side at most
BATCH_WORDS = 100_000
_NODE = (1 << 32) - 1
_HASH = 0x9E3779B97F4A7C15
DECODE_RUN = 8192


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _State(dict):
    """A state of the transducer: byte -> (next state, last token of the encoding up to and with the byte).

    ``live`` has, for each place where a token may have begun, the trie node of the bytes since
    then and the last token (-1: none) of the encoding up to there, as (last token + 1) << 32 | node.
    """

    __slots__ = ("live", "machine", "number")

    def __init__(self, live: tuple, machine: Transducer, number: int) -> None:
        self.live, self.machine, self.number = live, machine, number

    def __missing__(self, byte: int) -> tuple[_State, int]:
        self[byte] = step = self.machine._step(self.live, byte)
        return step

    def step(self, byte: int) -> tuple[_State, int]:
        """The same, but not kept here."""
        return self.get(byte) or self.machine._step(self.live, byte)


class _Steps:
    """Steps of numbered states for many words at once: (state << 8 | byte) -> (next state << 32 | token).

    A hash table in two arrays, at most half full; a key sits at its hash or in the next free place after it.
    """

    def __init__(self) -> None:
        self._empty(12)

    def _empty(self, bits: int) -> None:
        self.used, self.bits = 0, bits
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=np.int64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if it is not there."""
        at = self._places(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            there = self.keys[at[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.values[at[rest[same]]]
            rest = rest[~same & (there >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are not there yet, each once."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            held = self.keys >= 0
            keys, values = np.append(self.keys[held], keys), np.append(self.values[held], values)
            self._empty((2 * len(keys)).bit_length())
        self.used += len(keys)
        at = self._places(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several for one place, the last one gets it
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (len(self.keys) - 1)


class Transducer:
    """The merges of a rank table, compiled into a transducer from bytes to ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.go: dict[int, int] = {}  # (trie node << 8 | byte) -> node
        self.ends: list[int] = [-1]  # node -> id of the token that ends there
        self.depth: list[int] = [0]
        inner = {0}
        for token, number in ranks.items():
            node = 0
            for b in token:
                inner.add(node)
                nxt = self.go.get(node << 8 | b)
                if nxt is None:
                    nxt = self.go[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.ends[node] = number
        self.inner = [node in inner for node in range(len(self.ends))]
        self.sizes = np.zeros(max(self.token) + 1, dtype=np.int64)
        self.sizes[list(self.size)] = list(self.size.values())
        self.one = {i: i for i in self.token}  # an id -> the one object for it
        self.spines: dict[int, tuple[list, list, bool, bool] | None] = {}
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.numbered: list[_State] = []
        self.steps = _Steps()
        self.start = self._state((0,))

    def _state(self, live: tuple) -> _State:
        state = self.states.get(live)
        if state is None:
            if len(self.states) >= STATES:
                self.reset()
            state = self.states[live] = _State(live, self, len(self.numbered))
            self.numbered.append(state)
        return state

    def _merge(self, piece: bytes, stop: int) -> list[bytes]:
        """Plain merging, lowest rank first, until ``stop`` parts are left or none merge."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > stop:
            found = [r for r in map(get, map(bytes.__add__, parts, parts[1:])) if r is not None]
            if not found:
                break
            whole = self.token[min(found)]
            at = next(i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] == whole)
            parts[at : at + 2] = [whole]
        return parts

    def _spine(self, number: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]], bool, bool] | None:
        """What the first and the last byte of a token are part of while it is merged: (rank, bytes) from
        the byte to the token, and of each whether its ranks rise. None if merging its bytes doesn't give the token."""
        if number not in self.spines:
            token = self.token[number]
            if len(token) == 1:
                known = [(-1, token)], [(-1, token)], True, True
            elif len(parts := self._merge(token, 2)) == 2 and self._merge(token, 1) == [token]:
                left, right = (self._spine(self.ranks[p]) for p in parts)
                known = left and right and (
                    left[0] + [(number, token)],
                    right[1] + [(number, token)],
                    left[2] and left[0][-1][0] < number,
                    right[3] and right[1][-1][0] < number,
                )
            else:
                known = None
            self.spines[number] = known
        return self.spines[number]

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the bytes of token ``a`` (-1: none) and then ``b`` gives just these two.

        It does unless, while both are being merged, what the last byte of ``a`` is part of and what the
        first byte of ``b`` is part of merge with each other first (on equal ranks the left one goes first).
        """
        spine = self._spine(b)
        if spine is None or a < 0:
            return spine is not None
        _, left, _, rises = self._spine(a)
        right = spine[0]
        if not (rises and spine[2]):
            return self._merge(self.token[a] + self.token[b], 1) == [self.token[a], self.token[b]]
        i = j = 0
        while True:
            until_a = left[i + 1][0] if i + 1 < len(left) else 1 << 60
            until_b = right[j + 1][0] if j + 1 < len(right) else 1 << 60
            r = self.ranks.get(left[i][1] + right[j][1])
            if r is not None and r < until_a and r <= until_b:
                return False
            if until_a == until_b == 1 << 60:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def _step(self, live: tuple, byte: int) -> tuple[_State, int]:
        """Work out one step of the determinised transducer: the next state, and the last token of the
        encoding up to and with this byte."""
        go, ends, inner, fits = self.go.get, self.ends, self.inner, self.fits
        moved, whole = [], -1
        for place in live:
            nxt = go((place & _NODE) << 8 | byte)
            if nxt is None:
                continue
            token = ends[nxt]
            if whole < 0 and token >= 0:
                last = (place >> 32) - 1
                pair = last << 32 | token
                good = fits.get(pair)
                if good is None:
                    if len(fits) >= FITS:
                        fits.clear()
                    good = fits[pair] = self._fit(last, token)
                if good:
                    whole = token
            if inner[nxt]:
                moved.append(place & ~_NODE | nxt)
        if whole < 0:
            raise ValueError("the ranks lack a single byte")
        moved.append(whole + 1 << 32)
        return self._state(tuple(moved)), whole

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; a pre-token that is a token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        last: list[int] = []  # last token of the encoding up to each byte not settled yet
        state, at = self.start, 0
        while at < len(piece):
            upto = at + max(1, LOOKAHEAD - len(last))
            add = last.append
            for byte in piece[at:upto]:
                state, token = state[byte]
                add(token)
            at = upto
            if len(last) >= LOOKAHEAD:
                last = self._settle(state, last, out)
        return out + self._back(last, len(last))

    def encode_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many short pre-tokens (of a byte at least), worked out side by side."""
        out = [(self.one[i],) if (i := self.ranks.get(p)) is not None else () for p in pieces]
        todo = sorted((k for k, ids in enumerate(out) if not ids), key=lambda k: len(pieces[k]), reverse=True)
        if not todo:
            return out
        size = np.array([len(pieces[k]) for k in todo])
        text = np.frombuffer(b"".join(pieces[k] for k in todo), dtype=np.uint8)
        begin = np.cumsum(size) - size
        last = np.empty(len(text), dtype=np.int64)  # last token of the encoding of its piece up to each byte
        numbered = self.numbered
        state = np.full(len(todo), self.start.number, dtype=np.int64)
        for k in range(size[0]):
            at = begin[: np.searchsorted(-size, -k)] + k  # of the pieces with more than k bytes
            keys = state[: len(at)] << 8 | text[at]
            found = self.steps.find(keys)
            lacking = np.flatnonzero(found < 0)
            if len(lacking):
                new, where = np.unique(keys[lacking], return_inverse=True)
                made = [numbered[key >> 8].step(key & 255) for key in new.tolist()]
                if self.numbered is not numbered:  # the tables have started anew, so numbers are void
                    for i in todo:
                        out[i] = tuple(self.encode(pieces[i]))
                    return out
                values = np.array([nxt.number << 32 | token for nxt, token in made], dtype=np.int64)
                self.steps.add(new, values)
                found[lacking] = values[where]
            state[: len(at)] = found >> 32
            last[at] = found & 0xFFFFFFFF
        ends = np.zeros(len(text), dtype=bool)  # the bytes at which a token of the encoding ends
        at, left = begin + size - 1, size
        while len(at):
            ends[at] = True
            step = self.sizes[last[at]]
            at, left = (at - step)[left > step], (left - step)[left > step]
        ids = list(map(self.one.__getitem__, last[ends].tolist()))
        upto = np.cumsum(ends)[begin + size - 1].tolist()
        for i, a, b in zip(todo, [0, *upto], upto):
            out[i] = tuple(ids[a:b])
        return out

    def _back(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at - 1])
            at -= self.size[last[at - 1]]
        out.reverse()
        return out

    def _settle(self, state: _State, last: list[int], out: list[int]) -> list[int]:
        """Emit the tokens that all live hypotheses share; what is left is not settled."""
        shared: set[int] | None = None
        for place in state.live:
            at = len(last) - self.depth[place & _NODE]
            cuts = set()
            while at > 0:
                cuts.add(at)
                at -= self.size[last[at - 1]]
            shared = cuts if shared is None else shared & cuts
        at = max(shared, default=0)
        out += self._back(last, at)
        return last[at:]


class Codec:
    """A transducer with the pre-token pattern, a bounded memo of words, and the decoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.tokens = {i: t for t, i in ranks.items()}
        self.decimals = {i: str(i) for i in self.tokens}
        self.find = regex.compile(pattern).findall
        self.memo = _Memo()
        self.known = _Memo(lambda piece: tuple(self.transducer.encode(piece.encode("utf-8", "replace"))), 4)

    def pieces(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``."""
        return next(self.encode_run([text]))

    def encode_run(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text; the words of some millions of characters are worked out together.

        No pre-token crosses from a character that is not white space to a single space or line
        break followed by one that isn't either, so such places cut a text into words, which come
        from the memo. A text with white space side by side takes the pattern as a whole.
        """
        for _, some in runs(texts):
            number: dict[str, int] = defaultdict(count().__next__)  # of each distinct word
            cut = []
            for text in some:
                if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1].isspace():
                    cut.append(None)
                else:
                    words = iter(text.replace("\n", " \n").split(" "))
                    cut.append((next(words), list(map(number.__getitem__, words))))
            ids = self.words(list(number))
            for text, parts in zip(some, cut):
                if parts is not None and not parts[0][-1:].isspace() and all(found := list(map(ids.__getitem__, parts[1]))):
                    yield list(chain(self.pieces(parts[0]), chain.from_iterable(found)))
                else:
                    yield self.pieces(text)

    def words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word after a space, or after a line break if it begins with one; none if it is not a word."""
        out = list(map(self.memo.get, words))
        known: dict[str, tuple[int, ...]] = {}
        new = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            word = words[k]
            if (ids := self.memo.old.get(word)) is not None:
                out[k] = known[word] = ids
            elif not (bare := word.strip()) or (bare != word and "\n" + bare != word):
                out[k] = ()
            elif len(word) > MEMO_CHARS:
                out[k] = tuple(self.pieces(word if word[0] == "\n" else " " + word))
            else:
                new.append(k)
        self.memo.keep(known)
        for at in range(0, len(new), BATCH_WORDS):
            some = [words[k] for k in new[at : at + BATCH_WORDS]]
            made = self._learn(some)
            for k, word in zip(new[at : at + BATCH_WORDS], some):
                out[k] = made[word]
            self.memo.keep(made)
        return out

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words that the memo lacks; as no pre-token crosses from word to word, the pattern goes over all at once."""
        pieces = self.find("".join([w if w[0] == "\n" else " " + w for w in words]))
        first = [at for at, p in enumerate(pieces) if p[0] == " " or p[0] == "\n"]
        distinct = list(set(pieces))
        ids = dict(zip(distinct, self.transducer.encode_all([p.encode("utf-8", "replace") for p in distinct])))
        return {
            word: ids[pieces[a]] if b == a + 1 else tuple(chain.from_iterable([ids[p] for p in pieces[a:b]]))
            for word, a, b in zip(words, first, chain(first[1:], [len(pieces)]))
        }

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ``ids`` in parts; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        tokens = map(self.tokens.__getitem__, ids)
        while run := list(islice(tokens, DECODE_RUN)):
            yield machine.decode(b"".join(run))
        yield machine.decode(b"", final=True)


class _Memo(dict):
    """What ``make`` gives for short strings, in two generations: when the new one is full it becomes the old one, whose
    strings come back as they are met. So memory is bounded, and what is met often stays."""

    def __init__(self, make: Callable[[str], tuple[int, ...]] | None = None, part: int = 1) -> None:
        self.make, self.part = make, part
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= MEMO_CHARS:
            self.keep({key: ids})
        return ids

    def keep(self, new: dict[str, tuple[int, ...]]) -> None:
        """Take in what was made elsewhere, or as much of it as a generation holds."""
        entries = MEMO_ENTRIES // self.part
        if len(self) + len(new) > entries:
            self.old = dict(self)
            self.clear()
        self.update(new if len(new) <= entries else islice(new.items(), entries))


@functools.lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    """Made once per Python worker."""
    return Codec(load_ranks(path), pattern)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>, decoded string] of each document.

    A null text counts as empty: no ids, and both digests are that of no bytes.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), codec.encode_run(t.as_py() for t in batch.column(1)), strict=True):
                digest = hashlib.sha256(",".join(map(codec.decimals.__getitem__, ids)).encode()).hexdigest()
                back = hashlib.sha256()
                parts = []
                for part in codec.decode_stream(ids):
                    back.update(part.encode())
                    if with_ids:
                        parts.append(part)
                rows.append((doc_id, len(ids), digest, back.hexdigest(), ids if with_ids else None, "".join(parts)))
            n = 6 if with_ids else 4
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names=names[:n]
            )

    return text_docs(docs).mapInArrow(both, schema)
