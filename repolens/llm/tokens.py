"""Token ids of whole texts, exactly as the tokenizers library gives them, at the speed of Arrow.

A byte-level BPE never joins across pre-tokens, so a text's ids are its pre-tokens' ids in a row. Texts of
ASCII and the two-byte Latin letters U+00C0-U+017F are cut into pre-tokens with array operations on their
bytes; distinct pre-tokens go to the library once and are kept in a bounded table. Any other text, and any
that holds an added token's text, goes to the library whole. Tests hold all ways against plain library calls.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens kept by a worker; some 60 bytes each.
TABLE_WORDS = 1_000_000

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(78).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

#: Byte classes of the fast way: white space, letters, digits, others.
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
#: Bytes whose texts take the slow way: controls that some engines call white space, and all leads but C3-C5.
STRANGE = np.zeros(256, bool)
STRANGE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC0, 0xC1, 0xC2, *range(0xC6, 256)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each starts (one more at the end). Null is empty."""
    arr = texts.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0] if len(arr) else np.zeros(1, np.int64)


def cut(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. ``starts``: of the texts, and the end. The rule is that of byte-level BPE:
    contractions ('s 't 're 've 'm 'll 'd), runs of letters, digits or others with one space before, and
    white space, whose last character before a run stands alone (a space joins the run)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = CLASS[raw]
    begins = np.zeros(n + 3, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    begins[starts] = True
    begins[n:] = False
    first = np.zeros(n + 3, bool)
    first[starts] = True
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    begins[last] = True
    begins[last[raw[last] == 32] + 1] = False
    at = np.flatnonzero(raw == 39)
    if len(at):
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        at = at[begins[at] & begins[at + 1] & ~first[at + 1] & (CLASS[padded[at + 1]] == LETTER)]
        a, b, own = padded[at + 1], padded[at + 2], ~first[at + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = own & ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l")))
        for hit, k in ((at[one], 1), (at[two & ~one], 2)):
            begins[hit + 1] = False
            after = hit + 1 + k
            begins[after[after < n]] = True
    return np.flatnonzero(begins[:n])


def word_hashes(words: pa.Array) -> np.ndarray:
    """A polynomial hash of each word's bytes, all words at once."""
    raw, starts = flat(words)
    power, inverse = (np.full(len(raw) + 1, base, np.uint64) for base in (_BASE, _INVERSE))
    for x in (power, inverse):
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], out=sums[1:])
    h = (sums[starts[1:]] - sums[starts[:-1]]) * inverse[starts[:-1]]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


class WordTokenizer:
    """Ids of many texts at once; one for each worker and vocabulary file.

    Known pre-tokens are an Arrow array with their ids in a row beside it, found by a sorted array of hashes; the
    bytes are compared, so that equal hashes mean no more than a second look. A table that has grown past
    ``TABLE_WORDS`` keeps the half used last."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        (self.line_end,) = self.plain(["\n"])[0]
        self.words = pa.array([], pa.binary())
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int32)
        self.hashes, self.row_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.round = 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: pa.Array, hashes: np.ndarray) -> None:
        """Fresh pre-tokens go to the library as lines of a few long texts, since each text costs more than
        its words; a line end is a pre-token of its own. White space goes by itself."""
        words = fresh.to_pylist()
        blank = [i for i, w in enumerate(words) if w.isspace()]
        lines = [i for i, w in enumerate(words) if not w.isspace()] if blank else range(len(words))
        size = np.zeros(len(words), np.int32)
        parts: list[np.ndarray] = []
        own = self.plain([words[i].decode("utf-8") for i in blank])
        size[blank] = [len(got) for got in own]
        for low in range(0, len(lines), 10_000):
            part = lines[low : low + 10_000]
            (got,) = self.plain([b"\n".join([words[i] for i in part]).decode("utf-8") + "\n"])
            ids = np.array(got, np.uint32)
            line_end = ids == self.line_end
            ends = np.flatnonzero(line_end)
            if len(ends) != len(part):
                raise AssertionError("a pre-token holds a line end")
            size[part] = np.diff(ends, prepend=-1) - 1
            parts.append(ids[~line_end])
        parts += [np.array(got, np.uint32) for got in own]
        order = np.array([*lines, *blank], np.int64)
        begin = np.zeros(len(words), np.int64)
        begin[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        by = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[by])
        self.hashes, self.row_of = np.insert(self.hashes, at, hashes[by]), np.insert(self.row_of, at, len(self.words) + by)
        self.words = pa.concat_arrays([self.words, fresh])
        self.ids = np.concatenate([self.ids, *parts])
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.full(len(words), self.round, np.int32)])

    def _forget(self) -> None:
        """Keeps the half of the table that was used last."""
        kept = np.sort(np.argsort(self.used, kind="stable")[-(TABLE_WORDS // 2) :])
        size = self.size[kept].astype(np.int64)
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(self.begin[kept] - (ends - size), size) + np.arange(int(ends[-1]))]
        self.begin, self.size, self.used = ends - size, self.size[kept], self.used[kept]
        self.words = self.words.take(pa.array(kept))
        place = np.full(len(self.row_of), -1, np.int32)
        place[kept] = np.arange(len(kept))
        stays = place[self.row_of] >= 0
        self.hashes, self.row_of = self.hashes[stays], place[self.row_of[stays]]

    def _rows(self, distinct: pa.Array) -> np.ndarray:
        """Each pre-token's row in the table; those it hasn't are learned first."""
        self.round += 1
        if len(self.words) > TABLE_WORDS:
            self._forget()
        hashes = word_hashes(distinct)
        row = np.full(len(distinct), -1, np.int64)
        if len(self.words):
            by = np.argsort(hashes)
            at = np.minimum(np.searchsorted(self.hashes, hashes[by]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[by]
            by, likely = by[hit], self.row_of[at[hit]]
            same = pc.equal(self.words.take(pa.array(likely)), distinct.take(pa.array(by))).to_numpy(zero_copy_only=False)
            row[by[same]] = likely[same]
            self.used[likely[same]] = self.round
        unknown = np.flatnonzero(row < 0)
        if len(unknown):
            row[unknown] = len(self.words) + np.arange(len(unknown))
            self._learn(distinct.take(pa.array(unknown)), hashes[unknown])
        return row

    def _whole(self, texts: pa.Array, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which texts only the library reads right: those with strange bytes, and those that hold an added
        token's text."""
        strange = STRANGE[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        strange[lead[np.isin(raw[lead + 1], (0x97, 0xB7))]] = True
        where = np.flatnonzero(strange)
        slow = np.unique(np.searchsorted(starts, where, "right") - 1) if len(where) else where
        for token in self.added:
            held = pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
            slow = np.union1d(slow, np.flatnonzero(held)) if held.any() else slow
        return slow

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and where each text's start (one more at the end)."""
        raw, starts = flat(texts)
        slow = self._whole(texts, raw, starts)
        if len(slow):
            return self._mixed(raw, starts, slow)
        begins = cut(raw, starts)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        offsets = np.append(begins, len(raw))
        big = offsets[-1] >= 2**31
        words = pa.Array.from_buffers(pa.large_binary() if big else pa.binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64 if big else np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = words.dictionary_encode()
        row = self._rows(coded.dictionary.cast(pa.binary()))[coded.indices.to_numpy()]
        size = self.size[row].astype(np.int64)
        ends = np.cumsum(size)
        index = np.repeat(self.begin[row] - (ends - size), size) + np.arange(int(ends[-1]))
        before = np.concatenate([[0], ends])[np.searchsorted(begins, starts)]
        return self.ids[index], before

    def _mixed(self, raw: np.ndarray, starts: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some texts need the library whole: they go there, the others stay together."""
        texts = [raw[starts[i] : starts[i + 1]].tobytes() for i in range(len(starts) - 1)]
        own = dict(zip(slow.tolist(), self.plain([texts[i].decode("utf-8") for i in slow]), strict=True))
        fast = [i for i in range(len(texts)) if i not in own]
        ids, at = self.encode(pa.array([texts[i] for i in fast], pa.large_binary())) if fast else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k, i in enumerate(fast):
            parts[i] = ids[at[k] : at[k + 1]]
        for i, got in own.items():
            parts[i] = np.array(got, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
