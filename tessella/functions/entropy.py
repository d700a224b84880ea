"""Adaptive arithmetic coder over bytes: 32-bit range, byte-context model.

One row is one stream; streams are independent, so any number is coded in parallel.
Cumulative counts of a context are kept in a Fenwick tree: a symbol costs a few
steps instead of a sum over 256 counts.
"""

from __future__ import annotations

# Range bounds of the coder, and the model's start, step and rescaling point.
TOP = 0xFFFFFFFF
QUARTER = 0x40000000
HALF = 0x80000000
THREE_QUARTERS = 0xC0000000
START, STEP, MOST = 1, 2, 65535
FNV_START, FNV_PRIME = 2166136261, 16777619


class Model:
    """Counts of the next byte for each of 256 hashed contexts of the last `order` (1 to 4) bytes."""

    def __init__(self, order: int = 2) -> None:
        self.order = min(4, max(1, order))
        self.history = [0] * self.order
        self.counts: dict[int, list[int]] = {}
        self.trees: dict[int, list[int]] = {}
        self.totals: dict[int, int] = {}

    def context(self) -> int:
        h = FNV_START
        for b in self.history:
            h = ((h ^ b) * FNV_PRIME) & TOP
        h &= 255
        if h not in self.counts:
            self._fill(h, [START] * 256)
        return h

    def _fill(self, c: int, counts: list[int]) -> None:
        tree = [0, *counts]
        for i in range(1, 257):
            j = i + (i & -i)
            if j <= 256:
                tree[j] += tree[i]
        self.counts[c], self.trees[c], self.totals[c] = counts, tree, sum(counts)

    def below(self, c: int, symbol: int) -> int:
        tree, n = self.trees[c], 0
        while symbol:
            n += tree[symbol]
            symbol &= symbol - 1
        return n

    def find(self, c: int, target: int) -> tuple[int, int]:
        """The symbol whose range holds the target, and the counts below it."""
        tree, at, low, bit = self.trees[c], 0, 0, 256
        while bit:
            nxt = at + bit
            if nxt <= 256 and low + tree[nxt] <= target:
                at, low = nxt, low + tree[nxt]
            bit >>= 1
        return min(at, 255), low

    def update(self, c: int, symbol: int) -> None:
        if self.totals[c] + STEP >= MOST:
            self._fill(c, [(v >> 1) | 1 for v in self.counts[c]])
        self.counts[c][symbol] += STEP
        self.totals[c] += STEP
        tree, i = self.trees[c], symbol + 1
        while i <= 256:
            tree[i] += STEP
            i += i & -i
        self.history = [symbol, *self.history[:-1]]


def encode(symbols, order: int = 2, capacity: int | None = None) -> bytes:
    """The coded stream, padded with zero bits to whole bytes; an OverflowError where it takes more than `capacity` bytes."""
    model, low, high, pending, bits = Model(order), 0, TOP, 0, []

    def put(bit: int) -> None:
        nonlocal pending
        bits.append(bit)
        if pending:
            bits.extend([1 - bit] * pending)
            pending = 0

    for s in symbols:
        c = model.context()
        width, total = high - low + 1, model.totals[c]
        under = model.below(c, s)
        high = low + width * (under + model.counts[c][s]) // total - 1
        low = low + width * under // total
        while True:
            if high < HALF:
                put(0)
            elif low >= HALF:
                put(1)
                low -= HALF
                high -= HALF
            elif low >= QUARTER and high < THREE_QUARTERS:
                pending += 1
                low -= QUARTER
                high -= QUARTER
            else:
                break
            low, high = low << 1, high << 1 | 1
        model.update(c, s)
        if capacity is not None and len(bits) > capacity * 8:
            raise OverflowError("Overflow")
    pending += 1
    put(0 if low < QUARTER else 1)
    bits.extend([0] * (-len(bits) % 8))
    if capacity is not None and len(bits) > capacity * 8:
        raise OverflowError("Overflow")
    return int("1" + "".join(map(str, bits)), 2).to_bytes(len(bits) // 8 + 1, "big")[1:]


class Decoder:
    """Reads symbols from a stream; bits beyond its end count as zero, so short streams work too."""

    def __init__(self, data: bytes, order: int = 2) -> None:
        self.data, self.at, self.model = data, 32, Model(order)
        self.low, self.high = 0, TOP
        self.value = int.from_bytes((data[:4] + b"\0" * 4)[:4], "big")

    def __call__(self) -> int:
        m = self.model
        c = m.context()
        width, total = self.high - self.low + 1, m.totals[c]
        symbol, under = m.find(c, ((self.value - self.low + 1) * total - 1) // width)
        self.high = self.low + width * (under + m.counts[c][symbol]) // total - 1
        self.low = self.low + width * under // total
        while True:
            if self.high < HALF:
                pass
            elif self.low >= HALF:
                self.value -= HALF
                self.low -= HALF
                self.high -= HALF
            elif self.low >= QUARTER and self.high < THREE_QUARTERS:
                self.value -= QUARTER
                self.low -= QUARTER
                self.high -= QUARTER
            else:
                break
            self.low, self.high = self.low << 1, self.high << 1 | 1
            byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 0
            self.value = self.value << 1 | (byte >> (7 - (self.at & 7))) & 1
            self.at += 1
        m.update(c, symbol)
        return symbol


def decode(data: bytes, n: int, order: int = 2) -> bytes:
    d = Decoder(data, order)
    return bytes(d() for _ in range(n))


class BitWriter:
    """Bits, most significant first; `capacity` bytes at most."""

    def __init__(self, capacity: int | None = None) -> None:
        self.value, self.n, self.capacity = 0, 0, capacity

    def write(self, value: int, bits: int) -> None:
        if bits > 64 or bits < 0:
            raise ValueError("InvalidInput")
        if self.capacity is not None and self.n + bits > self.capacity * 8:
            raise OverflowError("Overflow")
        self.value = self.value << bits | value & ((1 << bits) - 1)
        self.n += bits

    def write_bytes(self, data: bytes) -> None:
        """Whole bytes, wherever in a byte the next bit is."""
        if self.capacity is not None and self.n + 8 * len(data) > self.capacity * 8:
            raise OverflowError("Overflow")
        self.value = self.value << 8 * len(data) | int.from_bytes(data, "big")
        self.n += 8 * len(data)

    def bytes(self) -> bytes:
        """All bits, padded with zeros to whole bytes."""
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


class BitReader:
    """Reads what BitWriter has written."""

    def __init__(self, data: bytes) -> None:
        self.value, self.n, self.at = int.from_bytes(data, "big"), len(data) * 8, 0

    def peek(self, bits: int) -> int:
        if bits > 64 or self.at + bits > self.n:
            raise ValueError("InvalidInput")
        return self.value >> (self.n - self.at - bits) & ((1 << bits) - 1)

    def advance(self, bits: int) -> None:
        if self.at + bits > self.n:
            raise ValueError("InvalidInput")
        self.at += bits

    def read(self, bits: int) -> int:
        out = self.peek(bits)
        self.advance(bits)
        return out


def bits_to_bytes(bits: int) -> int:
    """Whole bytes that hold so many bits."""
    return -(-bits // 8)
