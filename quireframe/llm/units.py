"""Texts as units: strings that no rule of a word-end tokenizer file reaches across, each encoded once.

Units end at white space, and where an ASCII letter or digit meets another kind of ASCII sign, apostrophes left out; a
text with `<|` in it, where a special token could stand, is cut at white space only. Letters are lowered here where
no later sign can join them. A block of texts is cut by array operations, its distinct units are encoded, and the
results are put in the units' places by one gather. A bounded memory keeps encodings from block to block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Bytes of text cut at once; a unit that is longer stays whole.
BLOCK = 1 << 21
#: Units kept in each generation of the memory, and the longest unit kept.
KEPT, KEPT_LEN = 100_000, 48
#: Fixed value: the pattern of the files that these rules hold for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)


def _kinds() -> np.ndarray:
    out = np.full(256, _OTHER, dtype=np.uint8)
    for b in range(33, 127):
        out[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[ord("'")] = _OTHER
    return out


def _borders(fine: bool) -> np.ndarray:
    """Whether a unit's border lies between two kinds of bytes."""
    out = np.zeros((5, 5), dtype=bool)
    out[_SPACE, :] = out[:, _SPACE] = True
    if fine:
        for a in (_LETTER, _MARK, _DIGIT):
            for b in (_LETTER, _MARK, _DIGIT):
                out[a, b] = a != b
    return out.ravel()


_KIND, _FINE, _COARSE = _kinds(), _borders(True), _borders(False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut(block: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of texts that stand one after another and begin at `first`, and where each unit starts."""
    n = len(block)
    kind = _KIND[block]
    begins = np.zeros(n + 1, dtype=bool)
    begins[first[first <= n]] = True
    begins[0] = begins[n] = True
    angle = (block[:-1] == ord("<")) & (block[1:] == ord("|"))
    border = np.ones(n + 1, dtype=bool)
    pairs = kind[:-1] * np.uint8(5) + kind[1:]
    if angle.any():
        border[1:n] = _COARSE[pairs]
    else:
        border[1:n] = _FINE[pairs]
        plain = np.ones(n, dtype=bool)
        plain[:-1] = block[1:] < 0x80  # a letter may be joined with a sign beyond ASCII that follows it
        block = np.where(plain, _LOWER[block], block)
    border |= begins
    solid = kind != _SPACE
    at = np.flatnonzero(solid & border[:-1])
    end = np.flatnonzero(solid & border[1:]) + 1
    offsets = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(end - at, out=offsets[1:])
    return binary(offsets, block[solid]), at


def binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(data)])


def views(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a large_binary array, and its n + 1 offsets."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, dtype=np.int64)
    return memoryview(data if data is not None else b""), at


def blocks(raw: np.ndarray, starts: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, where each row begins): short texts share a block; a long one is
    cut where white space stands, and all its blocks but the last end a row that goes on."""
    for i, j in common.row_runs(starts, most):
        a, b = int(starts[i]), int(starts[j])
        if b - a <= most:
            yield i, j, raw[a:b], starts[i : j + 1] - a
            continue
        while b - a > most:
            gaps = np.flatnonzero(_KIND[raw[a : a + most]] == _SPACE)
            if not len(gaps):  # a unit longer than a block is looked for its end, block by block
                k = a + most
                while k < b and not len(gaps := np.flatnonzero(_KIND[raw[k : k + most]] == _SPACE)):
                    k += most
                end = min(b, k + int(gaps[0]) + 1) if k < b else b
            else:
                end = a + int(gaps[-1]) + 1
            if end == b:
                break
            yield i, j, raw[a:end], np.array([0, end - a])
            a = end
        yield i, j, raw[a:b], np.array([0, b - a])


class Encoder:
    """Ids of texts by their units; encode: from distinct units to their ids as little-endian 32-bit integers."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], kept: int = KEPT):
        self._encode, self.kept = encode, common.Recent(kept)

    def of(self, units: list[bytes]) -> list[bytes]:
        kept = self.kept
        out = list(map(kept.young.get, units))
        missing = [k for k, ids in enumerate(out) if ids is None]
        for k in missing:
            out[k] = kept.get(units[k])
        missing = [k for k in missing if out[k] is None]
        if missing:
            for k, ids in zip(missing, self._encode([units[k] for k in missing]), strict=True):
                out[k] = ids
                if len(units[k]) <= KEPT_LEN:
                    kept.put(units[k], ids)
        return out

    def distinct(self, block: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Of a block of texts: which distinct unit stands at each place, where each row's units start (a row more), and the
        ids of the distinct ones."""
        words, at = cut(block, first)
        coded = words.dictionary_encode()
        ids = pa.array(self.of(coded.dictionary.to_pylist()), pa.large_binary())
        return coded.indices, np.searchsorted(at, first), ids

    def rows(self, raw: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
        """The ids of each row."""
        row, waiting = 0, []
        for i, j, block, first in blocks(raw, starts):
            indices, bounds, ids = self.distinct(block, first)
            data, offsets = views(pc.take(ids, indices))
            ends = offsets[bounds]
            for k in range(j - i):
                if i + k != row:
                    yield b"".join(waiting)
                    row, waiting = i + k, []
                waiting.append(bytes(data[ends[k] : ends[k + 1]]))
        if len(starts) > 1:
            yield b"".join(waiting)
