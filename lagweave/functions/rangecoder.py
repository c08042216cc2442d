"""An adaptive binary range coder, Exp-Golomb symbols and bit planes over it."""

from __future__ import annotations

TOP = 1 << 24
HALF = 1 << 10
RATE = 5
MASK = 0xFFFFFFFF


class Encoder:
    """Codes bits with 11-bit adaptive probabilities (of a zero) into bytes; carries run back through the output."""

    def __init__(self):
        self.low, self.range, self.out = 0, MASK, bytearray()

    def _shift(self) -> None:
        if self.low > MASK:
            self.low &= MASK
            k = len(self.out) - 1
            while self.out[k] == 255:
                self.out[k] = 0
                k -= 1
            self.out[k] += 1
        self.out.append(self.low >> 24)
        self.low = self.low << 8 & MASK

    def bit(self, model: list[int], at: int, bit: int) -> None:
        p = model[at]
        bound = (self.range >> 11) * p
        if bit:
            self.low += bound
            self.range -= bound
            model[at] = p - (p >> RATE)
        else:
            self.range = bound
            model[at] = p + (2 * HALF - p >> RATE)
        while self.range < TOP:
            self.range <<= 8
            self._shift()

    def raw(self, value: int, bits: int) -> None:
        for k in range(bits - 1, -1, -1):
            self.range >>= 1
            if value >> k & 1:
                self.low += self.range
            while self.range < TOP:
                self.range <<= 8
                self._shift()

    def finish(self) -> bytes:
        for _ in range(5):
            self._shift()
        return bytes(self.out)


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.range = data, 4, MASK
        self.code = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def _fill(self) -> None:
        while self.range < TOP:
            self.range <<= 8
            self.code = (self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & MASK
            self.at += 1

    def bit(self, model: list[int], at: int) -> int:
        p = model[at]
        bound = (self.range >> 11) * p
        if self.code < bound:
            self.range = bound
            model[at] = p + (2 * HALF - p >> RATE)
            bit = 0
        else:
            self.code -= bound
            self.range -= bound
            model[at] = p - (p >> RATE)
            bit = 1
        self._fill()
        return bit

    def raw(self, bits: int) -> int:
        value = 0
        for _ in range(bits):
            self.range >>= 1
            bit = self.code >= self.range
            if bit:
                self.code -= self.range
            value = value << 1 | bit
            self._fill()
        return value


LEAST_PREFIX = 20


class Signed:
    """Adaptive signed Exp-Golomb: zero flag and prefix by context, sign and suffix raw."""

    def __init__(self, contexts: int):
        self.zero = [HALF] * contexts
        self.prefix = [[HALF] * LEAST_PREFIX for _ in range(contexts)]

    def encode(self, coder: Encoder, context: int, value: int) -> None:
        coder.bit(self.zero, context, value != 0)
        if not value:
            return
        coder.raw(value < 0, 1)
        size = abs(value).bit_length() - 1
        model = self.prefix[context]
        for k in range(size):
            coder.bit(model, min(k, LEAST_PREFIX - 1), 1)
        coder.bit(model, min(size, LEAST_PREFIX - 1), 0)
        coder.raw(abs(value) - (1 << size), size)

    def decode(self, coder: Decoder, context: int) -> int:
        if not coder.bit(self.zero, context):
            return 0
        negative, size, model = coder.raw(1), 0, self.prefix[context]
        while coder.bit(model, min(size, LEAST_PREFIX - 1)):
            size += 1
        value = (1 << size) + coder.raw(size)
        return -value if negative else value


def encode_planes(values: list[int]) -> bytes:
    """Values as zig-zag numbers, bit plane by bit plane from the top, with contexts of neighbours that already show."""
    u = [2 * v - 1 if v > 0 else -2 * v for v in values]
    top = max(u, default=0).bit_length()
    coder, shown = Encoder(), [0] * (len(u) + 2)
    coder.raw(top, 6)
    for plane in range(top - 1, -1, -1):
        first, later = [HALF] * 9, [HALF] * 3
        for i, v in enumerate(u):
            bit = v >> plane & 1
            if shown[i + 1]:
                coder.bit(later, min(shown[i + 1] - 1, 2), bit)
                shown[i + 1] = min(shown[i + 1] + 1, 3)
            else:
                coder.bit(first, min(shown[i], 2) * 3 + min(shown[i + 2], 2), bit)
                shown[i + 1] = bit
    return coder.finish()


def decode_planes(data: bytes, n: int) -> list[int]:
    coder, u, shown = Decoder(data), [0] * n, [0] * (n + 2)
    for _ in range(coder.raw(6)):
        first, later = [HALF] * 9, [HALF] * 3
        for i in range(n):
            if shown[i + 1]:
                bit = coder.bit(later, min(shown[i + 1] - 1, 2))
                shown[i + 1] = min(shown[i + 1] + 1, 3)
            else:
                bit = coder.bit(first, min(shown[i], 2) * 3 + min(shown[i + 2], 2))
                shown[i + 1] = bit
            u[i] = u[i] << 1 | bit
    return [(x + 1) // 2 if x & 1 else -(x // 2) for x in u]
