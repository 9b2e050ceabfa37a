"""Token ids by a public tokenizer, in bulk.

A tokenizer file whose rules are ``RULES`` drops white space before anything else, so ids of a text are those of its
pieces, one after another. Each process keeps the ids of the pieces it has met, up to a bound, by two 64-bit hashes in
sorted arrays. New words of Latin letters, and those with a single mark after them, go to the library's model directly, all
other new pieces through the whole library. Texts for files with other rules go to the library as they are.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbuf import buffers, string_hashes

#: Pieces that a process remembers, of about 40 bytes each.
PIECES = 1_200_000
END = 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARKS = frozenset(".,!?;:)")
#: Letters below this are told apart from marks alike by all versions of Unicode; lower-casing U+0130 leaves a mark behind.
_LATIN, _DOTTED = "\u0250", "\u0130"
# The rules of a tokenizer file that allow for pieces.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# byte-level tokenizers write bytes that don't print as characters from 256 on, in their order
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINT} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINT))}


def _plain(text: str) -> bool:
    """Whether all letters are Latin ones that stay letters in lower case."""
    return text.isascii() or max(text) < _LATIN and _DOTTED not in text


def _splits(file: dict) -> bool:
    """Whether a tokenizer file has ``RULES`` and byte pairs with nothing between words, so that pieces can be encoded apart."""
    model = file["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
    words = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in file.get("added_tokens") or [])
    return plain and words and not file.get("truncation") and all(file.get(k) == v for k, v in RULES.items())


class Encoder:
    """Encodes texts with the tokenizer file at ``path``; special tokens aren't added."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.by_pieces = _splits(json.loads(self.library.to_str()))
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The process's encoder for this file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending
        self.checks = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)
        self.begin = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _ids(self, text: str) -> list[int]:
        if text.isalpha():
            if text.isascii():
                return [t.id for t in self.model.tokenize(text.lower())]
            if _plain(text):
                return [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(_BYTES))]
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> None:
        found: list[list[int]] = []
        stems: dict[str, list[int]] = {}
        for piece in new:
            text = piece.decode()
            mark = None
            if len(text) > 1 and text[-1] in _MARKS and text[-2].isalnum() and _plain(text):
                text, mark = text[:-1], text[-1]
            ids = stems.get(text)
            if ids is None:
                ids = stems[text] = self._ids(text)
            if mark:
                if mark not in stems:
                    stems[mark] = self._ids(mark)
                ids = ids + stems[mark]
            found.append(ids)
        at, n = len(self.place), len(new)
        while at + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        sizes = np.fromiter(map(len, found), np.int64, n)
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.size[at : at + n] = sizes
        self.begin[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = [i for x in found for i in x]
        self.used += total

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts whose UTF-8 bytes are between the offsets, each with ``END`` after it, and how many each has."""
        rows = len(offs) - 1
        if not self.by_pieces:
            whole = [raw[a:z].tobytes().decode() for a, z in zip(offs, offs[1:], strict=False)]
            found = [[*x.ids, END] for x in self.library.encode_batch(whole, add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, rows)
        if len(self.place) > PIECES:
            self._forget()
        solid = ~_SPACE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offs[:-1]] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:-1]
        start = np.flatnonzero(begins)
        per = np.diff(np.searchsorted(start, offs))
        left = np.cumsum(solid)  # bytes that aren't white space, up to each
        edge = np.append(left[start] - 1, left[-1] if len(left) else 0).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(raw[solid].tobytes())])
        coded = pc.dictionary_encode(pieces)
        h, check = string_hashes(*buffers(coded.dictionary))
        to = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), np.int32)
        hit = np.zeros(len(h), bool)
        if len(self.keys):
            near = np.minimum(to, len(self.keys) - 1)
            hit = (self.keys[near] == h) & (self.checks[near] == check)
            known = self.place[near]
        new = np.flatnonzero(~hit)
        if len(new):
            known[new] = np.arange(len(self.place), len(self.place) + len(new))
            self._learn(coded.dictionary.take(pa.array(new)).to_pylist())
            order = new[np.argsort(h[new])]
            self.keys, self.checks, self.place = (np.insert(x, to[order], y[order]) for x, y in ((self.keys, h), (self.checks, check), (self.place, known)))
        at = known[np.asarray(coded.indices)]
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        row_end = np.concatenate([[0], ends])[np.cumsum(per)] if rows else np.zeros(0, np.int64)
        where = np.repeat(self.begin[at] - (ends - size), size)
        where += np.arange(total)
        own = np.ones(total + rows, bool)
        own[row_end + np.arange(rows)] = False
        out = np.full(total + rows, END, np.uint32)
        out[own] = self.flat[where]
        return out, np.diff(np.concatenate([[0], row_end])) + 1
