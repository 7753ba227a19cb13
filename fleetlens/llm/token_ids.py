"""Token ids of whole texts with a public tokenizer, one encoding per distinct word and task.

``word_bpe_49k.json`` cuts a text into runs of letters, single digits and runs of other signs
before it merges anything, so the ids of a text are the ids of its parts in order. A part is
encoded with the ``tokenizers`` library when a worker first meets it and looked up after that.

The short way is taken only by texts for which it is the same by construction: code points
below U+0300, none that normalisation or the library's white space rule could treat in another
way, no apostrophe (contractions cross parts), no special token. All others are encoded whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from fleetlens.llm.codes import doc_of, point_values, text_slices, value_hash

LIMIT = 0x300
SLOT_BITS = 21
POOL_IDS = 1 << 23
SPACE, LETTER, DIGIT, OTHER, HARD = range(5)


def _kind(c: int) -> int:
    ch = chr(c)
    category = unicodedata.category(ch)
    if c in (9, 10, 13, 32):
        return SPACE
    if category in ("Cc", "Zs", "Zl", "Zp") or ch == "'" or len(ch.lower()) > 1 or unicodedata.normalize("NFC", ch) != ch:
        return HARD
    return LETTER if category[0] == "L" else DIGIT if category[0] == "N" else OTHER


def _part_tokenizer(path: str):
    """The tokenizer of the file for parts between spaces: they are lower-cased, normal and cut already."""
    from tokenizers import Tokenizer, pre_tokenizers

    # Tasks fill the cores already.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.normalizer = None
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


class WordEncoder:
    """Ids of texts by the tokenizer file at ``path``.

    What it has encoded is kept in a table with one place for each value of a hash's upper bits, where a
    later part replaces an earlier one, and the ids in a pool that starts again when it is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_file(path), _part_tokenizer(path)
        self.kind = np.array([_kind(c) for c in range(LIMIT)] + [HARD], np.uint8)
        self.low = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(LIMIT)] + [LIMIT], np.uint32)
        self.value = point_values(self.low)
        # A token that ends a part carries this mark in the vocabulary file.
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pool = np.empty(POOL_IDS // 8, np.uint32)
        self._clear()

    def _clear(self) -> None:
        # No hash with these upper bits belongs to this place.
        self.hashes = ~(np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
        self.spans = np.zeros(1 << SLOT_BITS, np.int64)  # where the ids begin in the pool, and in the lower half how many
        self.used = 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> np.ndarray:
        """``words`` holds distinct parts. They are encoded in long lines and cut at end marks."""
        lines = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.parts.encode_batch_fast(lines, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("the tokenizer does not keep the parts of a text apart")
        starts = np.concatenate([[0], stops[:-1]])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(ids), self.used), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        spans = (starts + self.used) << 32 | (stops - starts)
        self.used += len(ids)
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        # Of parts that share a place the last one stays, in both tables.
        _, last = np.unique(slots[::-1], return_index=True)
        last = len(slots) - 1 - last
        self.hashes[slots[last]], self.spans[slots[last]] = hashes[last], spans[last]
        return spans

    def _spans(self, small: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Where the ids of every part are in the pool."""
        if self.used > POOL_IDS:
            self._clear()
        hashes = value_hash(self.value[small], starts, stops)
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        spans = self.spans[slots]
        missing = np.flatnonzero(self.hashes[slots] != hashes)
        if len(missing):
            new, some, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            some = missing[some]
            text = self.low[small].astype("<u4").tobytes()
            spans[missing] = self._learn(new, [text[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True)])[back]
        return spans

    def slice_ids(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and how many each text has."""
        small = np.minimum(points, LIMIT).astype(np.intp)
        kind = self.kind[small]
        marks = np.flatnonzero(points[:-1] == ord("<"))
        hard_at = np.concatenate([np.flatnonzero(kind == HARD), marks[points[marks + 1] == ord("|")]])
        hard = np.unique(doc_of(hard_at, bounds))
        for d in hard.tolist():
            kind[bounds[d] : bounds[d + 1]] = SPACE
        solid = kind != SPACE
        inside = solid & (kind != DIGIT)  # continues the part of the point before
        inside[1:] &= kind[1:] == kind[:-1]
        inside[bounds[:-1][bounds[:-1] < len(kind)]] = False
        starts = np.flatnonzero(solid & ~inside)
        # A part ends where the next one starts, or at white space, or with its text.
        solid[:-1] &= ~inside[1:]
        spans = self._spans(small, starts, np.flatnonzero(solid) + 1)
        size = spans & 0xFFFFFFFF
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat((spans >> 32) - total[:-1], size) + np.arange(total[-1])]
        counts = np.diff(total[np.searchsorted(starts, bounds)])
        if len(hard):
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for d in hard.tolist():
                text = points[bounds[d] : bounds[d + 1]].tobytes().decode("utf-32-le", "surrogatepass")
                pieces[d] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                counts[d] = len(pieces[d])
            ids = np.concatenate(pieces)
        return ids, counts


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, shared by its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_slices(batch: pa.RecordBatch, path: str):
    """(rows, ids end to end, where each row's ids start: n + 1 numbers) of slices of the batch."""
    for part, points, bounds in text_slices(batch, "text"):
        ids, counts = encoder(path).slice_ids(points, bounds)
        yield part, ids, np.concatenate([[0], np.cumsum(counts)])
