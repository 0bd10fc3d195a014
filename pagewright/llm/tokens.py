"""Token ids of whole texts by the tokenizers library, from a dictionary of pieces.

A byte-level vocabulary encodes each match of its splitting pattern by itself. Texts are cut here only where such a match
ends whatever stands around (before a space that goes with the next word, around other white space, between letters,
digits and punctuation of ASCII), so the ids of a piece don't depend on its neighbours. All pieces of a run of texts are
found by array operations on their bytes and numbered by Arrow's dictionary encoding; the library encodes each piece
that a worker hasn't met, and a text's ids are gathered by piece numbers. Texts with special tokens, and vocabularies
of other kinds, go to the library as they are.
"""

from __future__ import annotations

import json
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagewright.llm.common import release, text_slices

#: Bytes of texts that are encoded together, bytes that a worker's dictionary may take; beyond it the dictionary starts
#: anew, which changes no result.
RUN_BYTES, CACHE_BYTES = 1 << 20, 64 << 20
#: Pieces that the library gets at once: it needs some kilobytes for each.
LINES = 4_000
#: What an entry of the dictionary costs besides its bytes and ids.
_ENTRY = 210

_SPACE, _WHITE, _LETTER, _DIGIT, _PUNCT, _QUOTE = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _WHITE
_KIND[32] |= _SPACE
for _letters, _kind in ((string.ascii_letters, _LETTER), (string.digits, _DIGIT), (string.punctuation, _PUNCT)):
    _KIND[np.frombuffer(_letters.encode(), np.uint8)] = _kind
_KIND[ord("'")] |= _QUOTE
#: The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, the others from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_STANDS = "".join(chr(b) if b in _SHOWN else chr(256 + k - sum(x < b for x in _SHOWN)) for k, b in enumerate(range(256)))
#: White space beyond ASCII, by UTF-8 bytes: fixed values of Unicode.
_WIDE_WHITE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: The letters among code points of two UTF-8 bytes in scripts that part words by spaces.
_TWO_LETTER = np.array([0xC0 <= c < 0x530 and unicodedata.category(chr(c))[0] == "L" for c in range(0x800)])
_WIDE_FIRST = np.zeros(256, bool)
_WIDE_FIRST[[w[0] for w in _WIDE_WHITE]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _white(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = (kind & _WHITE) != 0
    first = np.flatnonzero(_WIDE_FIRST[data])
    if len(first):
        second = data[np.minimum(first + 1, len(data) - 1)]
        third = data[np.minimum(first + 2, len(data) - 1)]
        for w in _WIDE_WHITE:
            on = (data[first] == w[0]) & (second == w[1])
            if len(w) == 3:
                on &= third == w[2]
            at = first[on]
            for k in range(len(w)):
                white[at + k] = True
    return white


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 texts; none for what isn't ASCII, but for letters of two bytes."""
    kind = _KIND[data]
    two = np.flatnonzero((data & 0xE0) == 0xC0)
    two = two[_TWO_LETTER[(data[two] & 31).astype(np.int64) << 6 | data[two + 1] & 63]]
    kind[two] = kind[two + 1] = _LETTER
    return kind


def piece_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pieces start in data; edges are the places where texts start and end."""
    kind = kinds(data)
    white = _white(data, kind)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    start = edge[:n].copy()
    k0, k1, w0, w1, inside = kind[:-1], kind[1:], white[:-1], white[1:], ~edge[1:n]
    cut = w1 & ~w0  # a run of white space starts
    cut |= w0 & ~w1 & ((k0 & _WHITE) != 0) & ((k0 & _SPACE) == 0)  # after a last one that is no space
    word0, word1 = (k0 & (_LETTER | _DIGIT)) != 0, (k1 & (_LETTER | _DIGIT)) != 0
    cut |= word0 & ((k1 & _PUNCT) != 0)
    cut |= ((k0 & _PUNCT) != 0) & word1 & ~(((k0 & _QUOTE) != 0) & ((k1 & _LETTER) != 0))
    cut |= word0 & word1 & (((k0 ^ k1) & _DIGIT) != 0)
    start[1:] |= cut & inside
    # the last of a run goes by itself or with the next word, unless the text ends with it
    start[:-1] |= ((k0 & _WHITE) != 0) & ~w1 & inside
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line = self._plain(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else -1
        # read from the parts: the vocabulary as a whole, spelled out, takes tens of megabytes
        split = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        plain = self.tokenizer.normalizer is None and type(self.tokenizer.model).__name__ == "BPE" and self.line >= 0
        self.by_pieces = plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.bytes = 0

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, pieces: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which of the pieces, none of which has a line end, are one match of the splitting pattern, namely letters after
        at most a space; and all of them as the vocabulary spells them."""
        joined = b"\n".join(pieces)
        data = np.frombuffer(joined, np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        letter = (kinds(data) & _LETTER) != 0
        letter[starts[data[starts] == 32]] = True
        letter[starts[1:] - 1] = True
        words = np.logical_and.reduceat(letter, starts)
        words &= (data[starts] != 32) | (np.diff(np.append(starts, len(data) + 1)) > 2)
        return words, joined.decode("latin-1").translate(_STANDS).split(_STANDS[10])

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Adds pieces to the dictionary; their numbers. Words go to the library's merges at once, other pieces without
        line ends and white space at their ends as lines of one text."""
        ids: list[int] = []
        counts, order = [], []

        def add(k: int, some: list[int]) -> None:
            ids.extend(some)
            counts.append(len(some))
            order.append(k)

        lined, alone = [], []
        flat = [k for k, p in enumerate(pieces) if b"\n" not in p]
        if flat:
            merge = self.tokenizer.model.tokenize
            words, shown = self._words([pieces[k] for k in flat])
            for j in np.flatnonzero(words).tolist():
                found = [x.id for x in merge(shown[j])]
                ids += found
                counts.append(len(found))
                order.append(flat[j])
            lined = [flat[j] for j in np.flatnonzero(~words).tolist()]
        texts = {k: pieces[k].decode() for k in lined}
        alone = [k for k, t in texts.items() if t[-1].isspace() or t[0] != " " and t[0].isspace()]
        for k in alone:
            del texts[k]
        lined = list(texts)
        for k in range(0, len(lined), LINES):
            some = lined[k : k + LINES]
            found = self._plain(["\n".join([texts[j] for j in some])])[0].tolist()
            ends = [j for j, x in enumerate(found) if x == self.line]
            if len(ends) != len(some) - 1:
                raise ValueError("the vocabulary joins line ends with what stands beside them")
            for j, a, b in zip(some, [0, *(e + 1 for e in ends)], [*ends, len(found)], strict=True):
                add(j, found[a:b])
        alone += sorted(set(range(len(pieces))) - set(flat))
        for j, found in zip(alone, self._plain([pieces[k].decode() for k in alone]), strict=True):
            add(j, found.tolist())

        known, end = len(self.slot), len(self.slot) + len(pieces)
        self.ids = _grown(self.ids, self.used + len(ids))
        self.first, self.count = _grown(self.first, end), _grown(self.count, end)
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[known:end] = counts
        self.first[known:end] = self.used + np.cumsum(counts) - self.count[known:end]
        self.slot.update(zip([pieces[k] for k in order], range(known, end), strict=True))
        self.used += len(ids)
        self.bytes += sum(map(len, pieces)) + 4 * len(ids) + _ENTRY * len(pieces)
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = np.arange(known, end)
        return numbers

    def rest(self) -> None:
        """Gives memory back at the end of a task: workers that wait keep the vocabulary and a small dictionary."""
        if self.bytes > CACHE_BYTES // 8:
            self._forget()
        release()

    def _window(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data, and how many there are before each edge."""
        starts = piece_starts(data, edges)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        if self.bytes > CACHE_BYTES:
            self._forget()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False)
        slots = np.fromiter(map(self.slot.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            slots[unknown] = self._learn(distinct[unknown].tolist())
        slots = slots[pieces.indices.to_numpy()]
        counts = self.count[slots]
        before = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.first[slots] - before[:-1], counts)
        at += np.arange(len(at))
        return self.ids[at], before[np.searchsorted(starts, edges)]

    def _run(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[bounds[k]:bounds[k + 1]] and their bounds. Very long texts are cut before a space between words."""
        a, n, done, ids, out = 0, len(data), 0, [], np.zeros(len(bounds), np.int64)
        while a < n:
            b = n
            if n - a > 2 * RUN_BYTES:
                k = _KIND[data[a + RUN_BYTES : a + 2 * RUN_BYTES]]
                word = (k & (_LETTER | _DIGIT)) != 0
                at = np.flatnonzero(word[:-2] & ((k[1:-1] & _SPACE) != 0) & word[2:])
                if len(at):
                    b = a + RUN_BYTES + int(at[-1]) + 1
            lo, hi = np.searchsorted(bounds, [a, b]).tolist()
            hi += b == n and hi < len(bounds)
            mine = np.unique(np.concatenate([bounds[lo:hi] - a, [0, b - a]]))
            some, before = self._window(np.ascontiguousarray(data[a:b]), mine)
            if b == n:
                hi = len(bounds)
            out[lo:hi] = done + before[np.searchsorted(mine, bounds[lo:hi] - a)]
            done += len(some)
            ids.append(some)
            a = b
        return (np.concatenate(ids) if len(ids) != 1 else ids[0]) if ids else np.zeros(0, np.uint32), out

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) of runs of texts: row first + k has ids[bounds[k]:bounds[k + 1]]. Null as the empty text."""
        column = pc.fill_null(column, "")
        if not self.by_pieces:
            alone = np.arange(len(column))
        else:
            hit = np.zeros(len(column), bool)
            for s in self.special:
                hit |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
            alone = np.flatnonzero(hit)
        first = 0
        for row in [*alone.tolist(), len(column)]:
            for k, data, bounds in text_slices(column.slice(first, row - first), RUN_BYTES):
                yield first + k, *self._run(data, bounds)
            if row < len(column):
                ids = self._plain([column[row].as_py()])[0]
                yield row, ids, np.array([0, len(ids)])
            first = row + 1


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n values at least."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
