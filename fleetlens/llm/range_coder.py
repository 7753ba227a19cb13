"""An adaptive context-mixing range coder for token ids, run on many blocks in step.

Blocks are independent: each starts from the same empty model and has its own checksum. That
lets numpy take one id of some thousand blocks at a time.

An id below 65 536 is coded in one step of a 64-bit range coder.

* Mixing. The order-2 and order-1 contexts each predict the id that came last in them, and keep whether
  their last two predictions were right. The pair of these records selects an adaptive split of the range
  into "order 2 is right", "order 1 is right" and "neither".
* Order 0, if neither: the id's class by adaptive frequencies, then its place in the class in equal shares.
  Tokenizers number their merges by falling frequency, so classes widen with the id: 16 for each doubling.

The contexts learn after every id; splits and frequencies are counted anew after the ids named in ``TURNS``.
Encoder and decoder call the same ``Model`` methods, so they cannot drift apart.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LANES, GROUP, SLOTS, SHIFT = 1024, 8192, 2048, 128, 9
TURNS = (32, 128, 384)
BITS, WIDEST = 10, 11
ALL = 2 * BITS + WIDEST
U = np.uint64
WORD, LITTLE = U(32), U(1 << 32)
# The class of an id below 512 is id // 32; its first id, and the bits of a place in it.
CLASSES = 128
_OCTAVE = np.maximum(np.arange(CLASSES) // 16 - 1, 0)
PLACE_BITS = 5 + _OCTAVE
FIRST_ID = (np.arange(CLASSES) - 16 * _OCTAVE) << PLACE_BITS
CLASS_OF = np.repeat(np.arange(CLASSES, dtype=np.uint8), 1 << PLACE_BITS)
# Counts that a block begins with: outcomes (by the records of order 2 and order 1) and classes.
_RIGHT = np.array([1, 4, 4, 16])
FIRST_OUTCOMES = np.stack([np.repeat(_RIGHT, 4), np.tile(_RIGHT, 4) // 2 + 1, np.full(16, 6)], axis=1).astype(np.int32)
FIRST_CLASSES = (8 - np.arange(CLASSES) // 16).astype(np.int32)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Per symbol where its share of 2 ** BITS starts, and in the upper 16 bits its size, one at least."""
    free = (1 << BITS) - counts.shape[-1]
    ends = np.cumsum(counts, axis=-1, dtype=np.float32)
    ends *= np.float32(free) / ends[..., -1:]
    ends = ends.astype(np.int32)
    ends[..., -1] = free
    ends += np.arange(1, counts.shape[-1] + 1, dtype=np.int32)
    starts = np.zeros_like(ends)
    starts[..., 1:] = ends[..., :-1]
    ends -= starts
    ends <<= 16
    ends |= starts
    return ends


class Model:
    """The adaptive state of ``n`` blocks."""

    def __init__(self, n: int):
        self.table = np.zeros(2 * n * SLOTS, np.uint32)
        self.base = np.arange(2 * n).reshape(2, n) * SLOTS
        self.lane = np.arange(n)
        self.mark = np.zeros((2, n), np.uint16)  # hashes of the order-1 and the order-2 context
        self.outcomes, self.classes = FIRST_OUTCOMES[None], FIRST_CLASSES[None]
        self._share(n)

    def _share(self, n: int) -> None:
        split = np.zeros((n, 16, 4), np.int32)
        split[:, :, :3] = _shares(self.outcomes)
        self.split = split.ravel()
        self.part = np.broadcast_to(_shares(self.classes), (n, CLASSES)).ravel()

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For the first ``n`` blocks: the ids predicted by order 1 and order 2, and the pair of their records."""
        self.at = self.base[:, :n] + (self.mark[:, :n] >> SHIFT)
        self.entry = self.table[self.at]
        record = self.entry.astype(np.uint8) & np.uint8(3)
        return self.entry >> 2, record[1] << 2 | record[0]

    def learn(self, ids: np.ndarray, right: np.ndarray) -> None:
        """``right``: whether order 1 and order 2 were."""
        self.table[self.at] = (self.entry & 1) << 1 | ids.astype(np.uint32) << 2 | right
        n = len(ids)
        one = ids * np.uint16(40503)
        np.add(one, self.mark[0, :n] * np.uint16(5), out=self.mark[1, :n])
        self.mark[0, :n] = one

    def turn(self, codes: np.ndarray, classes: np.ndarray) -> None:
        """Counts the latest rows of the blocks that go on: 4 * records + outcome, and classes."""
        n = codes.shape[1]
        lane = self.lane[:n]
        self.outcomes = self.outcomes[:n] + np.bincount((lane * 64 + codes).ravel(), minlength=n * 64).reshape(n, 16, 4)[:, :, :3].astype(np.int32)
        literal = (lane * CLASSES + classes)[codes & 2 > 0]
        self.classes = self.classes[:n] + np.bincount(literal, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.int32)
        self._share(n)


def _periods(sizes: np.ndarray):
    """(first id, for each id up to the next turn how many blocks have it, how many blocks go on), for sizes in falling order."""
    have = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), "left").tolist()
    ends = [t for t in TURNS if t < sizes[0]]
    for a, b in zip([0, *ends], [*ends, int(sizes[0])], strict=True):
        yield a, have[a:b], have[b]


class _Out:
    """Range encoder of many blocks; 32 bits leave at a time. Carries stay in the words until the end."""

    def __init__(self, n: int, most: int):
        self.low, self.range = np.zeros(n, U), np.full(n, U(2**64 - 1))
        self.n, self.words, self.at = n, np.zeros((most + 3) * n, U), np.arange(n) + n

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        n = len(start)
        low, span = self.low[:n], self.range[:n]
        span >>= U(ALL)
        add = span * start
        span *= size
        low += add
        over = np.flatnonzero(low < add)
        self.words[self.at[over] - self.n] += U(1)
        due = np.flatnonzero(span < LITTLE)
        at, out = self.at[due], low[due]
        self.words[at] = out >> WORD
        self.at[due] = at + self.n
        low[due] = out << WORD
        span[due] <<= WORD

    def close(self) -> list[bytes]:
        for shift in (WORD, U(0)):
            self.words[self.at] = (self.low >> shift) & U(2**32 - 1)
            self.at += self.n
        words = self.words.reshape(-1, self.n)
        for k in range(len(words) - 1, 1, -1):
            words[k - 1] += words[k] >> WORD
        return [w[1:u].tobytes() for w, u in zip(np.ascontiguousarray(words.T.astype("<u4")), self.at // self.n, strict=True)]


class _In:
    """The matching decoder."""

    def __init__(self, payloads: list[bytes]):
        sizes = np.array([len(p) // 4 for p in payloads])
        self.words = np.concatenate([np.frombuffer(b"".join(p[: len(p) // 4 * 4] for p in payloads), "<u4"), np.zeros(2, "<u4")]).astype(U)
        self.at = np.minimum(np.cumsum(sizes) - sizes, len(self.words) - 2)
        self.code = self.words[self.at] << WORD | self.words[self.at + 1]
        self.at += 2
        self.range = np.full(len(payloads), U(2**64 - 1))

    def look(self, n: int) -> np.ndarray:
        self.range[:n] >>= U(ALL)
        # Only a damaged block holds more than ALL bits here.
        return (self.code[:n] // self.range[:n] & U((1 << ALL) - 1)).view(np.int64)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        n = len(start)
        code, span = self.code[:n], self.range[:n]
        code -= span * start.view(U)
        span *= size.view(U)
        due = np.flatnonzero(span < LITTLE)
        at = self.at[due]
        # Words past a damaged block's end are another's; its checksum tells.
        code[due] = code[due] << WORD | self.words.take(at, mode="clip")
        self.at[due] = at + 1
        span[due] <<= WORD


def _encode_group(grid: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """``grid``: a column of ids per block."""
    model, out = Model(len(sizes)), _Out(len(sizes), len(grid))
    for begin, have, staying in _periods(sizes):
        n = have[0]
        lane = model.lane[:n]
        rows = grid[begin : begin + len(have), :n]
        codes = np.full(rows.shape, 2, np.uint8)
        for k, x, code in zip(have, rows, codes, strict=True):
            x = x[:k]
            guess, record = model.predict(k)
            right = guess == x
            wrong = (~right).view(np.uint8)
            code[:k] = record << 2 | wrong[1] + (wrong[0] & wrong[1])
            model.learn(x, right)
        classes = CLASS_OF[rows]
        for t in range(0, len(have), 64):
            code, kind, ids = codes[t : t + 64], classes[t : t + 64], rows[t : t + 64]
            split, part = model.split[lane * 64 + code].astype(np.int64), model.part[lane * CLASSES + kind].astype(np.int64)
            spare = WIDEST - PLACE_BITS[kind]
            literal = code & 2 > 0
            inner = ((part & 0xFFFF) << WIDEST) + (part >> 16) * ((ids - FIRST_ID[kind]) << spare)
            start = ((split & 0xFFFF) << BITS + WIDEST) + (split >> 16) * np.where(literal, inner, 0)
            size = (split >> 16) * np.where(literal, (part >> 16) << spare, 1 << BITS + WIDEST)
            for k, a, b in zip(have[t : t + 64], start.view(U), size.view(U), strict=True):
                out.put(a[:k], b[:k])
        if staying:
            model.turn(codes[:, :staying], classes[:, :staying])
    return out.close()


def _groups(n: int):
    """Even slices of about GROUP of ``n`` blocks."""
    edges = np.linspace(0, n, max(1, round(n / GROUP)) + 1).astype(int).tolist() if n else []
    return zip(edges[:-1], edges[1:], strict=True)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """(number of ids, crc32 of the ids as little-endian 32-bit numbers, payload) per block."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids of over 16 bits")
    found = []
    for a, b in _groups(-(-len(ids) // block)):
        part = ids[a * block : b * block]
        sizes = np.minimum(block, len(part) - block * np.arange(b - a))
        padded = np.zeros((b - a) * block, np.uint16)
        padded[: len(part)] = part
        payloads = _encode_group(np.ascontiguousarray(padded.reshape(b - a, block).T[: sizes[0]]), sizes)
        data = memoryview(part.astype("<u4").tobytes())
        found += [(k, zlib.crc32(data[4 * i * block : 4 * (i * block + k)]), p) for i, (k, p) in enumerate(zip(sizes.tolist(), payloads, strict=True))]
    return found


def _decode_group(payloads: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """A column of ids per block."""
    coder, model = _In(payloads), Model(len(sizes))
    grid = np.zeros((int(sizes[0]), len(sizes)), np.uint16)
    every = np.tile(np.arange(CLASSES, dtype=np.uint8), len(sizes))
    for begin, have, staying in _periods(sizes):
        n = have[0]
        codes, classes = np.zeros((2, len(have), n), np.uint8)
        class_at = np.repeat(every[: n * CLASSES], model.part[: n * CLASSES] >> 16)
        lane64, lane_part, lane_at = model.lane * 64, model.lane * CLASSES, model.lane << BITS
        for k, row, code, kinds in zip(have, grid[begin:], codes, classes, strict=False):
            guess, record = model.predict(k)
            value = coder.look(k)
            spot = lane64[:k] + (record << 2)
            top = value >> BITS + WIDEST
            second = model.split[spot + 1]
            one, two = top >= (second & 0xFFFF), top >= (second & 0xFFFF) + (second >> 16)
            which = one.view(np.uint8) + two
            split = model.split[spot + which].astype(np.int64)
            start, size = (split & 0xFFFF) << BITS + WIDEST, split >> 16
            inner = (value - start) // size
            # As if neither was right; what does not apply is dropped.
            kind = class_at[lane_at[:k] + (inner >> WIDEST)]
            part = model.part[lane_part[:k] + kind].astype(np.int64)
            spare = (WIDEST - PLACE_BITS)[kind]
            first, share = (part & 0xFFFF) << WIDEST, part >> 16
            place = (inner - first) // share >> spare
            start += np.where(two, size * (first + share * (place << spare)), 0)
            size *= np.where(two, share << spare, 1 << BITS + WIDEST)
            coder.take(start, size)
            x = np.where(two, FIRST_ID[kind] + place, np.where(one, guess[0], guess[1])).astype(np.uint16)
            row[:k], code[:k], kinds[:k] = x, record << 2 | which, kind
            model.learn(x, guess == x)
        if staying:
            model.turn(codes[:, :staying], classes[:, :staying])
    return grid


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of all blocks end to end; a block that does not match its checksum raises."""
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    out: list = [None] * len(blocks)
    for a, b in _groups(len(blocks)):
        some = order[a:b]
        columns = _decode_group([blocks[i][2] for i in some], np.array([blocks[i][0] for i in some]))
        for i, ids in zip(some, np.ascontiguousarray(columns.T).astype("<u4"), strict=True):
            out[i] = ids[: blocks[i][0]]
            if zlib.crc32(out[i]) != blocks[i][1]:
                raise ValueError("a block of token ids does not match its checksum")
    return np.concatenate([*out, np.empty(0, np.uint32)]).astype(np.uint32)
