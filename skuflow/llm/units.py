"""Tokenise whole texts through their distinct units.

A text is cut before each single space that stands between two plain characters. The
tokenisers used here never join what stands on both sides of such a cut: their rules put
the space at the head of what follows, or drop it. So the ids of a text are the ids of its
units one after another, and each unit is tokenised once per batch, or never, if a task met
it before. ``tests/llm`` compares this with the libraries on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from skuflow.llm.base import buffers, spans

_SPACE, _LINE = 0x20, 0x0A
#: Memory for the units a task keeps, and about what one takes besides its bytes. The older
#: half goes when it is full, which costs time only.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 240
#: Longer units are not kept.
KEEP_BYTES = 64

# Plain characters: printable ASCII, and U+00C0 to U+02FF, which take two bytes and hold
# neither white space nor marks that combine with what stands before.
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xCC] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_NEXT = _ASCII | _LEAD
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
# Second bytes of the letters U+00C0 to U+00FF; the signs for times and divided are none.
_WIDE_LETTER = np.zeros(256, bool)
_WIDE_LETTER[0x80:0xC0] = True
_WIDE_LETTER[[0x97, 0xB7]] = False
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:#*$%&()")] = True


def unit_offsets(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> np.ndarray:
    """Where the units of all texts begin, and the end of the last.

    ``marks``: cut also where tokenisers that split words by character class never join:
    between a letter and a punctuation mark that is neither an apostrophe nor part of a
    special token, and on both sides of a single line end between plain characters.
    """
    if len(data) < 2:
        return np.unique(offsets)
    cut = np.zeros(len(data) + 1, bool)
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets] = True

    def alone(byte: int) -> np.ndarray:
        """Where ``byte`` stands between two plain characters of one text."""
        at = np.flatnonzero(data[1:-1] == byte) + 1
        before = data[at - 1]
        plain = _ASCII[before] | (_TAIL[before] & _LEAD[data[at - 2]] & (at > 1))
        at = at[plain & _NEXT[data[at + 1]]]
        return at[~ends[at] & ~ends[at + 1]]

    cut[alone(_SPACE)] = True
    if marks:
        letter = _LETTER[data]
        letter[1:] |= _WIDE_LETTER[data[1:]] & (data[:-1] == 0xC3)
        cut[1:-1] |= _MARK[data[1:]] & letter[:-1]
        lines = alone(_LINE)
        cut[lines] = True
        cut[lines + 1] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


class UnitEncoder:
    """Ids of texts by way of ``encode``, which maps distinct units to their ids."""

    def __init__(
        self, encode: Callable[[list[str]], Sequence[bytes]], dtype: str = "<u2",
        marks: bool = False,
    ):
        self._encode, self._dtype, self._marks = encode, np.dtype(dtype), marks
        self.clear()

    def clear(self) -> None:
        """Forget all units."""
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._held = 0

    @contextmanager
    def task(self) -> Iterator[UnitEncoder]:
        """Use by one task: what it kept is freed at its end, as workers live on."""
        try:
            yield self
        finally:
            self.clear()

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units."""
        new, old = self._new, self._old
        found = [new.get(u) or old.get(u) for u in units]
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            texts = [units[i].decode() for i in missing]
            for i, ids in zip(missing, self._encode(texts), strict=True):
                found[i] = ids
        held = self._held
        for i in missing:
            unit, ids = units[i], found[i]
            if len(unit) <= KEEP_BYTES:
                new[unit] = ids
                held += len(unit) + len(ids) + ENTRY_BYTES
                if held > CACHE_BYTES // 2:
                    self._old, self._new, held = new, {}, 0
                    new = self._new
        self._held = held
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offsets of each text's ids."""
        ids, counts, unit_at = self.encode_units(data, offsets)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.searchsorted(unit_at, offsets)]

    def encode_units(
        self, data: np.ndarray, offsets: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of ids of each unit, and where the units begin."""
        unit_at = unit_offsets(data, offsets, self._marks)
        n = len(unit_at) - 1
        if n < 1:
            return np.zeros(0, self._dtype), np.zeros(0, np.int64), unit_at
        units = pa.LargeStringArray.from_buffers(
            n, pa.py_buffer(unit_at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
        ).dictionary_encode()
        index = units.indices.to_numpy(zero_copy_only=False)
        values, at = buffers(units.dictionary)
        raw, at = values.tobytes(), at.tolist()
        parts = self.ids_of([raw[a:b] for a, b in zip(at, at[1:], strict=False)])
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // self._dtype.itemsize
        flat = np.frombuffer(b"".join(parts), self._dtype)
        starts = np.cumsum(lengths) - lengths
        counts = lengths[index]
        return flat[spans(starts[index], counts)], counts, unit_at
