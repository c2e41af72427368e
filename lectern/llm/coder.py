"""An adaptive context-mixing range coder for token ids, run over many blocks at once.

Each block is coded by itself from a fresh model.  An id is first met with the id that
followed the last two ids before, then with the id that followed the last one: two yes/no decisions whose
probability mixes (in the logistic domain, with weights learned on the way) what the order-2, order-1
and order-0 state say.  An id that neither predicts is coded by order 0: how often the block holds each of
its ids stands at its head, and the sorted list of them is the table of intervals; the model knows ids by
their ranks in it.  Both decisions and the id narrow the range once.  All arithmetic is on integers, so a block decodes alike on every machine.

The blocks are lanes of numpy arrays: one step codes one id of every lane.
"""

from __future__ import annotations

import math

import numpy as np

BITS = 15
FULL = 1 << BITS
SLOTS = 1024
#: Ids in a block; counts and places of the table of order 0 have 16 bits.
LONGEST = 65_535
_FEW = 32  # blocks whose heads are made or read at a time
_LOW = 2**48 - 1
_SMALL = 2**32
# How common an id is in its block, in 16 levels: 1.5 per doubling of its count.
_LEVEL = np.array([0] + [min(15, (c**3).bit_length() // 2) for c in range(1, 1024)], np.int64)
_STRETCH = np.array([round(256 * math.log((i + 0.5) / (4096 - i - 0.5))) for i in range(4096)], np.int32)
_SQUASH = np.array([min(4064, max(32, round(4096 / (1 + math.exp(-(i - 2048) / 256))))) for i in range(4096)], np.int32)
# Rows of the model's inputs: orders 2, 1 and 0 of the first decision, orders 1 and 0 of the second.
_RATE = np.array([[4], [4], [5], [4], [5]], np.int32)
_CHANCE = np.array([[1 << 14]] * 3 + [[1 << 13]] * 2, np.int32)
_WEIGHT = np.array([[24_000]] * 3 + [[32_000]] * 2, np.int32)
_HEAVIEST = 100_000  # three weighted inputs stay within 32 bits
# What confidence gains: a wrong guess loses two, a right one gains one up to seven.
_SURER = np.array([-2] * 8 + [1] * 7 + [0], np.int32)
# Gaps between distinct ids at a block's head are written as (gap >> 4) + 1 and four bits, counts as they are.
_SHIFT = np.array([4, 0])


class _Writer:
    """Intervals ``[low, low + range)`` of 48 bits, 16 bits out at a time, per lane."""

    def __init__(self, lanes: int, width: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, 2**48, np.int64)
        self.words = np.zeros(lanes * width, np.uint16)
        self.first = np.arange(lanes) * width
        self.at = self.first.copy()

    def narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        n = len(size)
        low, at = self.low[:n], self.at[:n]
        low += start
        self._carry(low)
        short = size < _SMALL
        while short.any():
            self.words[at] = low >> 32  # written over by the next word where the lane stays
            at += short
            by = short.astype(np.int64) << 4
            low <<= by
            low &= _LOW
            size = size << by
            short = size < _SMALL
        self.range[:n] = size

    def _carry(self, low: np.ndarray) -> None:
        over = np.flatnonzero(low > _LOW)
        low[over] &= _LOW
        at = self.at[over]
        while len(at):
            at = at - 1
            self.words[at] += np.uint16(1)
            at = at[self.words[at] == 0]

    def finish(self) -> list[bytes]:
        """The words of each lane; the last one lies within its interval whatever (zeros) follows."""
        self.low += _SMALL - 1
        self._carry(self.low)
        self.words[self.at] = self.low >> 32
        words = self.words.astype("<u2", copy=False)
        return [words[a : b + 1].tobytes() for a, b in zip(self.first.tolist(), self.at.tolist(), strict=True)]


class _Reader:
    """The same intervals; ``code`` is how far the number read lies above the lower end."""

    def __init__(self, words: np.ndarray):
        lanes, width = words.shape
        self.range = np.full(lanes, 2**48, np.int64)
        self.words, self.at = words.ravel(), np.arange(lanes) * width + 3
        self.code = (words[:, 0].astype(np.int64) << 32) | (words[:, 1].astype(np.int64) << 16) | words[:, 2]

    def narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        n = len(size)
        code, at = self.code[:n], self.at[:n]
        code -= start
        short = size < _SMALL
        while short.any():
            by = short.astype(np.int64) << 4
            code <<= by
            code += self.words.take(at) * short
            at += short
            size = size << by
            short = size < _SMALL
        self.range[:n] = size


class _Model:
    """What the orders say of the next id, known as ``level << 16 | rank``; flat arrays hold a lane's entries side by side."""

    def __init__(self, lanes: int, ranks: int):
        # Slots of order 2, then of order 1, hold id * 8 + confidence; empty ones guess rank 0 (on level 0, so it is never that of an id).
        self.slots = np.zeros(lanes * (SLOTS + ranks), np.int32)
        self.chances = np.repeat(_CHANCE, lanes * 16, axis=1).ravel()
        self.weights = np.repeat(_WEIGHT, lanes, axis=1)
        lane = np.arange(lanes)
        self.slot, self.state = np.stack([lane * SLOTS, lanes * SLOTS + lane * ranks]), np.arange(5 * lanes).reshape(5, lanes) * 16
        self.before, self.last = np.zeros((2, lanes), np.int64)
        self.steps = 0

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The two guesses, and the probability (of 4,096) that each is right; it is 0 for a second guess like the first."""
        last = self.last[:n]
        at = np.empty((2, n), np.int64)
        at[0] = last * 40503 + self.before[:n] * 60493 >> 3 & SLOTS - 1
        at[1] = last
        at += self.slot[:, :n]
        held = self.slots.take(at, mode="clip")
        guess, sure = held >> 3, held & 7
        differ = guess[0] != guess[1]
        key = np.empty((5, n), np.int64)
        np.add(sure, differ.view(np.int8) << 3, out=key[:2])
        np.right_shift(guess, 16, out=key[2::2])
        key[3] = sure[1]
        key += self.state[:, :n]
        chance = self.chances.take(key, mode="clip")
        say = _STRETCH.take(chance >> 3, mode="clip")
        dot = say * self.weights[:, :n]
        mixed = np.empty((2, n), np.int32)
        np.add(dot[0], dot[1], out=mixed[0])
        mixed[0] += dot[2]
        np.add(dot[3], dot[4], out=mixed[1])
        mixed >>= 16
        mixed += 2048
        p = _SQUASH.take(mixed, mode="clip")
        p[1] *= differ
        self.kept = at, held, guess, sure, differ, key, chance, say, p
        return guess, p

    def learn(self, token: np.ndarray, hit: np.ndarray, found: np.ndarray) -> None:
        """``token`` came; ``hit`` and ``found``: the first, else the second guess was right."""
        at, held, guess, sure, differ, key, chance, say, p = self.kept
        n = len(token)
        tried = (differ & ~hit).view(np.int8)
        right = np.empty((2, n), np.int32)
        right[0], right[1] = hit, found
        error = right << 12
        error -= p
        error *= 6
        error[1] *= tried
        say[:3] *= error[0]
        say[3:] *= error[1]
        say >>= 10
        weights = self.weights[:, :n]
        weights += say
        self.steps += 1
        if self.steps % 16 == 0:
            np.minimum(weights, _HEAVIEST, out=weights)
            np.maximum(weights, -_HEAVIEST, out=weights)
        right *= FULL - 1
        move = np.negative(chance)
        move[:3] += right[0]
        move[3:] += right[1]
        move >>= _RATE
        move[3:] *= tried
        move += chance
        self.chances[key] = move
        same = guess == token
        held = held + _SURER.take(sure + (same.view(np.int8) << 3), mode="clip")
        np.putmask(held, ~(same | (sure > 1)), (token << 3) + 1)
        self.slots[at] = held
        self.before[:n] = self.last[:n]
        np.bitwise_and(token, 0xFFFF, out=self.last[:n])


def _parts(size: np.ndarray, p: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the parts of a range: first guess, second guess, and one place in the list of order 0."""
    one = (size >> 12) * p[0]
    size = size - one
    two = (size >> 12) * p[1]
    size -= two
    size >>= scale
    return one, two, size


def _interval(parts: tuple, hit: np.ndarray, found: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two, unit = parts
    start, size = one + two, unit * (entry & 0xFFFF)
    entry >>= 16
    entry &= 0xFFFF
    entry *= unit
    start += entry
    np.putmask(start, found, one)
    np.putmask(start, hit, 0)
    np.putmask(size, found, two)
    np.putmask(size, hit, one)
    return start, size


def _scale(sizes: np.ndarray) -> np.ndarray:
    return np.array([max(0, n - 1).bit_length() for n in sizes.tolist()])


def _entries(distinct: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``level << 48 | rank << 32 | place << 16 | count`` of the distinct ids of the blocks, of which each has ``distinct``; once for each time the id occurs."""
    firsts = np.cumsum(distinct) - distinct
    before = np.append(0, np.cumsum(counts))
    rank = np.arange(len(counts)) - np.repeat(firsts, distinct)
    place = before[:-1] - np.repeat(before[firsts], distinct)
    return np.repeat(_LEVEL.take(counts, mode="clip") << 48 | rank << 32 | place << 16 | counts, counts)


def _counted(blocks: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Heads of a few blocks, their numbers of distinct ids, and the entry of each id in its place."""
    sizes = np.array([len(b) for b in blocks])
    first = np.cumsum(sizes) - sizes
    orders = [np.argsort(b.astype(np.uint16), kind="stable") for b in blocks]
    ids = np.concatenate([b[o] for b, o in zip(blocks, orders, strict=True)]).astype(np.int64)
    fresh = np.diff(ids, prepend=-1) != 0
    fresh[first[sizes > 0]] = True
    starts = np.flatnonzero(fresh)
    counts = np.diff(np.append(starts, len(ids)))
    distinct = np.bincount(np.repeat(np.arange(len(blocks)), sizes)[starts], minlength=len(blocks))
    gaps = np.diff(ids[starts], prepend=-1) - 1
    begin = (np.cumsum(distinct) - distinct)[distinct > 0]
    gaps[begin] = ids[starts[begin]]
    listed, spots = np.split(_entries(distinct, counts), first[1:]), []
    for order, entries in zip(orders, listed, strict=True):
        spot = np.empty(len(order), np.int64)
        spot[order] = entries
        spots.append(spot)
    return _heads(distinct, gaps, counts), distinct, spots


def _heads(distinct: np.ndarray, gaps: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Heads of the blocks: gaps and counts as exponential Golomb numbers, all their leading parts in unary, then all remainders."""
    numbers = np.stack([gaps, counts - 1], axis=1)
    lead = np.frexp((numbers >> _SHIFT) + 1.0)[1].astype(np.int64) - 1
    wide = lead + _SHIFT
    rest = (numbers + (1 << _SHIFT) - (1 << wide)).ravel()
    lead, wide = lead.ravel(), wide.ravel()
    ends = np.append(0, np.cumsum(lead + 1))
    unary = np.zeros(ends[-1], np.uint8)
    unary[ends[1:] - 1] = 1
    # Remainders have at most 16 bits; of each, the lowest ``wide`` are written.
    tail = np.unpackbits(rest.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[np.arange(16) >= 16 - wide[:, None]]
    bounds = 2 * np.append(0, np.cumsum(distinct))
    at, to = ends[bounds].tolist(), np.append(0, np.cumsum(wide))[bounds].tolist()
    out = []
    for i, d in enumerate(distinct.tolist()):
        one, two = np.packbits(unary[at[i] : at[i + 1]]).tobytes(), np.packbits(tail[to[i] : to[i + 1]]).tobytes()
        out.append(np.array([d, len(one)], "<u2").tobytes() + one + two + b"\0" * ((len(one) + len(two)) & 1))
    return out


def _read_heads(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct ids in each block; all of them and their counts, one block after the other; and the lengths of the heads."""
    starts = np.array([np.frombuffer(p, "<u2", 2) for p in payloads], np.int64)
    distinct, sizes = starts[:, 0], starts[:, 1]
    bounds = 2 * np.append(0, np.cumsum(distinct))
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(p[4 : 4 + n] for p, n in zip(payloads, sizes.tolist(), strict=True)), np.uint8)))
    lead = np.diff(ones, prepend=-1) - 1
    full = np.flatnonzero(distinct)
    lead[bounds[full]] = ones[bounds[full]] - 8 * (np.cumsum(sizes) - sizes)[full]
    wide = (lead.reshape(-1, 2) + _SHIFT).ravel()
    ends = np.append(0, np.cumsum(wide))
    tails = (np.diff(ends[bounds]) + 7) // 8
    data = np.frombuffer(b"".join(p[4 + n : 4 + n + m] for p, n, m in zip(payloads, sizes.tolist(), tails.tolist(), strict=True)) + b"\0\0\0\0", np.uint8).astype(np.int64)
    begin = ends[:-1] + np.repeat(8 * (np.cumsum(tails) - tails) - ends[bounds[:-1]], 2 * distinct)
    byte = begin >> 3
    window = (data[byte] << 24) | (data[byte + 1] << 16) | (data[byte + 2] << 8) | data[byte + 3]
    numbers = (window >> (32 - (begin & 7) - wide) & ((1 << wide) - 1)) + (1 << wide)
    steps = np.append(0, np.cumsum(numbers[::2] - (1 << _SHIFT[0]) + 1))
    ids = steps[1:] - 1 - np.repeat(steps[bounds[:-1] // 2], distinct)
    whole = 4 + sizes + tails
    return distinct, ids, numbers[1::2], (whole + (whole & 1)).tolist()


def _by_length(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the blocks from long to short, and for each step how many have an id there."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), side="left")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks of at most ``LONGEST`` ids below 65,536."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks])
    if sizes.max() > LONGEST:
        raise ValueError(f"a block of {sizes.max()} ids is longer than {LONGEST}")
    order, active = _by_length(sizes)
    lanes, steps = len(blocks), len(active)
    by_step = np.zeros((steps, lanes), np.int64)
    heads, ranks = [], 1
    for begin in range(0, lanes, _FEW):
        some = order[begin : begin + _FEW].tolist()
        found = _counted([np.asarray(blocks[i]) for i in some])
        heads += found[0]
        ranks = max(ranks, int(found[1].max()))
        rows = np.zeros((len(some), steps), np.int64)
        for row, spot in zip(rows, found[2], strict=True):
            row[: len(spot)] = spot
        by_step[:, begin : begin + _FEW] = rows.T
    coder, m = _Writer(lanes, 2 * steps + 8), _Model(lanes, ranks)
    scale = _scale(sizes[order])
    for step, n in enumerate(active.tolist()):
        entry = by_step[step, :n]
        token = (entry >> 32).astype(np.int32)
        guess, p = m.predict(n)
        hit, found = guess == token
        found &= ~hit
        coder.narrow(*_interval(_parts(coder.range[:n], p, scale[:n]), hit, found, entry))
        m.learn(token, hit, found)
    out: list[bytes] = [b""] * lanes
    for i, head, words in zip(order.tolist(), heads, coder.finish(), strict=True):
        out[i] = head + words
    return out


def decode(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The blocks again."""
    if not payloads:
        return []
    lengths = np.array(sizes)
    order, active = _by_length(lengths)
    lengths = lengths[order]
    lanes, width = len(payloads), max(1, int(lengths[0]))
    table = np.zeros((lanes, width), np.int64)
    heads, named, distinct = [], [], []
    for begin in range(0, lanes, _FEW):
        some = order[begin : begin + _FEW].tolist()
        found = _read_heads([payloads[i] for i in some])
        fits = np.arange(width) < lengths[begin : begin + _FEW, None]
        if found[2].sum() != fits.sum():
            raise ValueError("the heads of blocks do not fit their lengths")
        table[begin : begin + _FEW][fits] = _entries(found[0], found[2])
        distinct.append(found[0])
        named.append(found[1].astype(np.uint32))
        heads += found[3]
    distinct, ids = np.concatenate(distinct), np.concatenate(named)
    words = np.zeros((lanes, max(map(len, payloads)) // 2 + 8), np.uint16)
    for row, (i, head) in enumerate(zip(order.tolist(), heads, strict=True)):
        got = np.frombuffer(payloads[i], "<u2", offset=head)
        words[row, : len(got)] = got
    first, top, table = np.arange(lanes) * width, np.maximum(lengths - 1, 0), table.ravel()
    coder, m, scale = _Reader(words), _Model(lanes, max(1, int(distinct.max()))), _scale(lengths)
    out = np.zeros((len(active), lanes), np.uint16)
    for step, n in enumerate(active.tolist()):
        guess, p = m.predict(n)
        parts = one, two, unit = _parts(coder.range[:n], p, scale[:n])
        over = coder.code[:n] - one
        hit, found = over < 0, over < two
        missed = ~found
        found &= ~hit
        over -= two
        np.maximum(over, 0, out=over)
        place = np.minimum((over.view(np.uint64) // unit.view(np.uint64)).view(np.int64), top[:n])
        entry = table.take(first[:n] + place)
        token = np.where(missed, entry >> 32, np.where(hit, guess[0], guess[1])).astype(np.int32)
        coder.narrow(*_interval(parts, hit, found, entry))
        m.learn(token, hit, found)
        out[step, :n] = m.last[:n]
    blocks: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    ranks, start = np.ascontiguousarray(out.T), (np.cumsum(distinct) - distinct).tolist()
    for row, i in enumerate(order.tolist()):
        blocks[i] = ids[ranks[row, : lengths[row]].astype(np.int64) + start[row]] if lengths[row] else blocks[i]
    return blocks
