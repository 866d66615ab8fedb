"""Token ids of whole texts by a public tokenizer, each distinct stretch of text encoded once per worker.

Both tokenizers split a text before they merge: white space after a printed character, and punctuation after a letter,
always begin a new part. A text is cut at such places only, so the ids of the parts in order are the ids of the text.
Nothing is cut inside a string of an added token, such as ``<|endoftext|>``. Distinct parts are found with numpy, encoded
by the library and remembered.
"""

from __future__ import annotations

import os

import numpy as np

from docloom.llm.words import run_hashes

PIECE = 1 << 20  # bytes cut into parts at once
REMEMBERED = 800_000  # distinct parts kept by one worker, about 50 MB
GROUP, GROUPS = 20, 200  # parts in one text for the library, and texts in one call: its results take much memory
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_POINT = _PRINTED & ~_LETTER
_POINT[48:58] = _POINT[39] = False  # digits; the apostrophe of contractions


def _printed_before(data: np.ndarray) -> np.ndarray:
    """Bytes that end a printed character: ASCII, or a two-byte letter U+00C0 to U+027F."""
    ends = _PRINTED[data]
    ends[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
    return ends


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two tables of columns, each by its first column, as one."""
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


class PartTokenizer:
    """Ids by ``tokenizers`` for many texts. With ``added``, strings of special tokens get the ids of those tokens, as the
    library gives them by default; without, they are ordinary text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        known = [t for t in self.library.get_added_tokens_decoder().values() if added or not t.special]
        self.tokens = [t.content.encode() for t in known]
        # Tokens that look at their neighbours or at normalised text leave no safe place to cut.
        self.uncut = any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in known)
        mark = self.library.encode("\x00", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._forget()

    def _forget(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        # Hash, head, first id and number of ids of the parts known, by hash: most of them, and the few learned last.
        self.old, self.new = none, none
        self.stock, self.n_ids = np.zeros(1 << 16, np.uint32), 0

    def _simple(self, parts: list[bytes]) -> np.ndarray:
        """Which parts may stand between two marks: begin with a blank or letter, end with a letter, have no mark and no added
        token. Parts with either are only looked for where the parts together hold one."""
        if self.mark is None or self.uncut:
            return np.zeros(len(parts), bool)
        ends = np.frombuffer(b"".join(p[:1] + (b"\0\0" + p)[-3:] for p in parts), np.uint8).reshape(-1, 4)
        first, before, last = ends[:, 0], ends[:, 2], ends[:, 3]
        accented = (before == 0xC3) & (last >= 0x80) & (last < 0xC0) & (last != 0x97) & (last != 0xB7) & (ends[:, 1] != 0)
        good = (_SPACE[first] | _LETTER[first]) & (_LETTER[last] | accented)
        whole = b"\n".join(parts)
        for unsafe in [b"\0", *self.tokens]:
            if unsafe in whole:
                good &= ~np.array([unsafe in p for p in parts])
        return good

    def _encode_new(self, parts: list[bytes]) -> list[list[int]]:
        done: dict[bytes, list[int]] = {}
        good = self._simple(parts).tolist()
        simple = [p for p, g in zip(parts, good, strict=True) if g]
        other = [p for p, g in zip(parts, good, strict=True) if not g]
        groups = [simple[i : i + GROUP] for i in range(0, len(simple), GROUP)]
        for i in range(0, len(groups), GROUPS):
            some = groups[i : i + GROUPS]
            joined = self.library.encode_batch_fast([b"\0".join(g).decode() for g in some], add_special_tokens=False)
            for group, out in zip(some, joined, strict=True):
                ids, at = out.ids, 0
                for part in group:
                    end = ids.index(self.mark, at) if self.mark in ids[at:] else len(ids)
                    done[part] = ids[at:end]
                    at = end + 1
        if other:
            texts = [p.decode("utf-8", "surrogatepass").encode("utf-8", "replace").decode() for p in other]
            for part, out in zip(other, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                done[part] = out.ids
        return [done[p] for p in parts]

    def _learn(self, hashes: np.ndarray, heads: np.ndarray, parts: list[bytes]) -> None:
        encoded = self._encode_new(parts)
        sizes = np.array([len(x) for x in encoded], np.int64)
        begins = self.n_ids + np.cumsum(sizes) - sizes
        end = self.n_ids + int(sizes.sum())
        if end > len(self.stock):
            self.stock = np.concatenate([self.stock[: self.n_ids], np.zeros(max(end, len(self.stock)), np.uint32)])
        self.stock[self.n_ids : end] = np.fromiter((i for x in encoded for i in x), np.uint32, end - self.n_ids)
        self.n_ids = end
        self.new = _merged(self.new, (hashes, heads, begins, sizes))
        if 8 * len(self.new[0]) > len(self.old[0]):
            self.old, self.new = _merged(self.old, self.new), tuple(x[:0] for x in self.new)

    def _look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Which hashes are known, and head, first id and number of ids of each."""
        known, facts = np.zeros(len(hashes), bool), tuple(np.zeros(len(hashes), x.dtype) for x in self.old[1:])
        for part in (self.old, self.new):
            if len(part[0]):
                at = np.minimum(np.searchsorted(part[0], hashes), len(part[0]) - 1)
                here = part[0][at] == hashes
                known |= here
                for out, values in zip(facts, part[1:], strict=True):
                    out[here] = values[at[here]]
        return known, facts

    def _ids_of(self, raw: bytes, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts of ``data`` that begin at ``starts``, and how many each has."""
        lengths = np.diff(np.append(starts, len(data)))
        hashes = run_hashes(data.astype(np.uint64) + np.uint64(1), starts)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        heads = np.zeros(len(starts), np.uint64)
        for k in range(7):  # the first bytes and the length tell parts of equal hash apart
            heads |= np.where(lengths > k, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
        heads |= (lengths & 0xFF).astype(np.uint64) << np.uint64(56)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.old[0]) + len(self.new[0]) > REMEMBERED:
            self._forget()
        known, facts = self._look_up(distinct)
        if not known.all():
            new = first[~known]
            self._learn(distinct[~known], heads[new], [raw[s : s + n] for s, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)])
            known, facts = self._look_up(distinct)
        if not (heads == facts[0][back]).all():
            raise ValueError("two parts of text share a 64-bit hash")
        begins, sizes = facts[1][back], facts[2][back]
        total = int(sizes.sum())
        return self.stock[np.arange(total) - np.repeat(np.cumsum(sizes) - sizes - begins, sizes)], sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each (null: none)."""
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = b"".join(coded)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(c) for c in coded])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(coded) else np.zeros(0, np.int64)
        inner = np.zeros(len(data), bool)  # bytes of an added token after its first
        for token in self.tokens:
            found = raw.find(token)
            while found >= 0:
                inner[found + 1 : found + len(token)] = True
                found = raw.find(token, found + 1)
        counts, out, at, span = np.zeros(len(texts), np.int64), [], 0, PIECE
        while at < len(data):
            part = data[at : at + span]
            cut = np.zeros(len(part), bool)
            cut[0] = True
            if not self.uncut:
                cut[1:] = (_SPACE[part[1:]] & _printed_before(part)[:-1]) | (_POINT[part[1:]] & _LETTER[part[:-1]])
                cut &= ~inner[at : at + span]
            inside = begins[np.searchsorted(begins, at) : np.searchsorted(begins, at + len(part))] - at
            cut[inside] = True
            starts = np.flatnonzero(cut)
            if at + len(part) < len(data):
                if len(starts) == 1:  # no place to cut: look further
                    span *= 2
                    continue
                part, starts = part[: starts[-1]], starts[:-1]
            ids, sizes = self._ids_of(raw[at : at + len(part)], part, starts)
            out.append(ids)
            owner = np.searchsorted(begins, starts + at, "right") - 1
            counts += np.bincount(owner, sizes, len(texts)).astype(np.int64)
            at, span = at + len(part), PIECE
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts


_LOADED: dict[str, PartTokenizer] = {}


def tokenizer(path: str) -> PartTokenizer:
    """One tokenizer per worker process and file, with the ids of the untouched library."""
    if path not in _LOADED:
        _LOADED[path] = PartTokenizer(path, added=True)
    return _LOADED[path]
