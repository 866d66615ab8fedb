"""Words of texts as numpy arrays: their places and 64-bit hashes, for whole batches at once.

A word is a maximal run of 0-9, a-z (A-Z is lower-cased first) and characters from U+0080. All of these bytes stand
for themselves in UTF-8, so the work is done on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 19  # bytes handled at once; numpy needs about 40 bytes of memory for each
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1 << 16, np.uint64)
_POWERS[1:] = np.cumprod(np.full((1 << 16) - 1, _BASE, np.uint64))

# The same words in DuckDB's SQL, of a column named text.
WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def lowered(raw: bytes) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[np.frombuffer(raw, np.uint8)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that all bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run of ``values`` that begins at ``starts`` and ends where the next begins.
    Zeros count for nothing, so runs may be padded with them."""
    ends = np.append(starts[1:], len(values))
    place = np.arange(len(values), dtype=np.int64) - np.repeat(starts, ends - starts)
    powers = _POWERS[place & 0xFFFF]
    if len(values) > 1 << 16 and (place >> 16).any():
        powers = powers * ((place >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return mix(np.add.reduceat(values.astype(np.uint64) * powers, starts))


def words_of(text: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and hash of every word of one buffer, in order. Long buffers are taken in pieces that end
    between words."""
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    found, at = [], 0
    while at < len(data):
        low = _LOWER[data[at : at + PIECE]]
        if at + len(low) < len(data):
            gaps = np.flatnonzero(~_WORD[low])
            if len(gaps):
                low = low[: gaps[-1] + 1]
            else:  # one word longer than a piece
                more = np.flatnonzero(~_WORD[_LOWER[data[at:]]])
                low = _LOWER[data[at : at + int(more[0]) + 1 if len(more) else len(data)]]
        inside = _WORD[low]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            found.append((starts + at, ends + at, run_hashes(np.where(inside, low, 0)[starts[0] :], starts - starts[0])))
        at += len(low)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of given words (already lower-case)."""
    return np.array([words_of(w.encode())[2][0] for w in words], np.uint64)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of many texts, a few MB at a time: (first, last + 1 text, bytes, where each text begins in them,
    index of each text's first word (one more at the end), word starts, word ends, hashes)."""
    i = 0
    while i < len(texts):
        parts, size, j = [], 0, i
        while j < len(texts) and (not parts or size < PIECE):
            raw = (texts[j] or "").encode("utf-8", "surrogatepass")
            parts.append(raw)
            size += len(raw) + 1
            j += 1
        raw = b"\n".join(parts)
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        starts, ends, hashes = words_of(raw)
        yield i, j, raw, begins[:-1], np.searchsorted(starts, begins), starts, ends, hashes
        i = j
