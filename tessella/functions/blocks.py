"""8x8 block transform: tables, vectorised kernels, and the symbol stream of a frame.

Kernels take any number of blocks at once (n, 64).  Coefficients are rounded to a
millionth, so ties of the quantiser don't hang on the order of summation.
"""

from __future__ import annotations

import numpy as np

# The standard JPEG luminance table.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]


def zigzag_order() -> list[int]:
    """Block index of each position of the zig-zag scan."""
    cells = [(x, y) for x in range(8) for y in range(8)]
    return [y * 8 + x for x, y in sorted(cells, key=lambda c: (c[0] + c[1], c[1] if (c[0] + c[1]) % 2 else c[0]))]


ZIGZAG = zigzag_order()


def basis() -> np.ndarray:
    """(64, 64): row v*8+u holds the DCT-II basis function (u, v) over y*8+x."""
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, 1 / np.sqrt(2), 1)[:, None] / 2
    return np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)


BASIS = basis()


def quant_table(quality: int) -> np.ndarray:
    q = min(100, max(1, int(quality)))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(LUMINANCE) * scale + 50) // 100, 1, 255)


def half_away(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def forward(blocks: np.ndarray) -> np.ndarray:
    return np.round(blocks @ BASIS.T, 6) + 0.0


def inverse(coefficients: np.ndarray) -> np.ndarray:
    return np.round(coefficients @ BASIS, 6) + 0.0


def quantize(coefficients: np.ndarray, table: np.ndarray) -> np.ndarray:
    return half_away(np.round(coefficients / table, 9)).astype(np.int64)


def split(frame: np.ndarray) -> np.ndarray:
    """Blocks (n, 64) of a frame (h, w) in raster order."""
    h, w = frame.shape
    return frame.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 64)


def join(blocks: np.ndarray, width: int) -> np.ndarray:
    n = width // 8
    return blocks.reshape(-1, n, 8, 8).transpose(0, 2, 1, 3).reshape(-1, width)


def to_pixels(values: np.ndarray) -> np.ndarray:
    return np.clip(half_away(values), 0, 255).astype(np.uint8)


def wrap16(x: np.ndarray | int):
    return (x + 32768) % 65536 - 32768


def fold16(x: np.ndarray | int):
    """Signed to unsigned: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return ((x << 1) ^ (x >> 15)) & 0xFFFF


def unfold16(x: int) -> int:
    return wrap16((x >> 1) ^ -(x & 1))


def block_symbols(zigzag: np.ndarray, before: int) -> list[int]:
    """Bytes of one block: DC difference, (run, high, low) for each non-zero AC value, end mark 255."""
    dc = int(fold16(wrap16(int(zigzag[0]) - before)))
    out, last = [dc >> 8, dc & 255], 0
    for k in np.flatnonzero(zigzag[1:]) + 1:
        u = int(fold16(int(zigzag[k])))
        out += [int(k) - last - 1, u >> 8, u & 255]
        last = int(k)
    return [*out, 255]


def read_block(next_symbol, before: int) -> np.ndarray:
    """The zig-zag values of one block; the end mark is read even after coefficient 63."""
    z = np.zeros(64, dtype=np.int64)
    z[0] = wrap16(before + unfold16(next_symbol() << 8 | next_symbol()))
    at = 1
    while True:
        run = next_symbol()
        if run == 255:
            return z
        at += run
        if at >= 64:
            raise ValueError("a coefficient lies beyond its block")
        value = unfold16(next_symbol() << 8 | next_symbol())
        if value:
            z[at] = value
            at += 1


def best_vectors(now: np.ndarray, ref: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(dx, dy, sad) of each block in raster order: least sum of differences, then least dy, then least dx."""
    h, w = now.shape
    now, ref = now.astype(np.int64), ref.astype(np.int64)
    out = []
    for by in range(0, h, 8):
        for bx in range(0, w, 8):
            y0, y1, x0, x1 = max(0, by - window), min(h - 8, by + window), max(0, bx - window), min(w - 8, bx + window)
            views = np.lib.stride_tricks.sliding_window_view(ref[y0 : y1 + 8, x0 : x1 + 8], (8, 8))
            sad = np.abs(views - now[by : by + 8, bx : bx + 8]).sum(axis=(2, 3))
            k = int(sad.argmin())
            dy, dx = divmod(k, sad.shape[1])
            out.append((x0 + dx - bx, y0 + dy - by, int(sad.flat[k])))
    return out


def compensate(ref: np.ndarray, vectors: list[tuple[int, int]]) -> np.ndarray:
    """Blocks (n, 64) of the reference, each moved by its vector."""
    h, w = ref.shape
    places = ((by, bx) for by in range(0, h, 8) for bx in range(0, w, 8))
    return np.stack([ref[by + dy : by + dy + 8, bx + dx : bx + dx + 8].reshape(64) for (by, bx), (dx, dy) in zip(places, vectors, strict=True)])
