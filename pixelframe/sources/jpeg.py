"""Baseline JPEG files from numpy: no subsampling, and code tables of one length that follow from a rule."""

from __future__ import annotations

import struct

import numpy as np

# fixed values: the luminance quantisation table of the JPEG standard, row by row, for quality 50
QUANTA = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
BASE = np.array(QUANTA.split(), float).reshape(8, 8)
#: places of a block from low to high frequencies, along its diagonals in turn
ORDER = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
COSINES = np.array([[np.sqrt((2 if k else 1) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
DC_SYMBOLS = list(range(12))  # sizes of differences, four bits each
AC_SYMBOLS = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]  # end, sixteen zeros, and runs with sizes, eight bits each
DC_CODE = {s: k for k, s in enumerate(DC_SYMBOLS)}
AC_CODE = {s: k for k, s in enumerate(AC_SYMBOLS)}


def quanta(quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((BASE * scale + 50) / 100), 1, 255)


def _planes(values: np.ndarray) -> np.ndarray:
    """(channels, rows, columns) of gray, or of brightness and two colour differences."""
    if values.shape[2] == 1:
        return values.transpose(2, 0, 1)
    r, g, b = values.transpose(2, 0, 1)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128])


def _coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised blocks in the order of their places: (blocks, 64)."""
    h, w = plane.shape
    grown = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = grown.reshape(grown.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    return np.rint(COSINES @ blocks @ COSINES.T / table).astype(int).reshape(-1, 64)[:, ORDER]


def _number(v: int) -> tuple[int, int]:
    """(size, bits) of a value: negative ones as the complement of their amount."""
    size = abs(v).bit_length()
    return size, v if v >= 0 else v + (1 << size) - 1


def _bits(block: list[int], before: int) -> str:
    size, bits = _number(block[0] - before)
    out = [f"{DC_CODE[size]:04b}", f"{bits:0{size}b}" if size else ""]
    run = 0
    last = max((k for k in range(1, 64) if block[k]), default=0)
    for v in block[1 : last + 1]:
        if not v:
            run += 1
            continue
        out += [f"{AC_CODE[0xF0]:08b}"] * (run // 16)
        size, bits = _number(v)
        out += [f"{AC_CODE[run % 16 << 4 | size]:08b}", f"{bits:0{size}b}"]
        run = 0
    return "".join(out) + (f"{AC_CODE[0]:08b}" if last < 63 else "")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _code_table(kind: int, symbols: list[int], length: int) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(len(symbols) if n == length else 0 for n in range(1, 17)) + bytes(symbols))


def jpeg_bytes(values: np.ndarray, height: int, width: int, channels: int, quality: int = 95) -> bytes:
    """A JPEG file of u8 values; gray images have one channel."""
    table = quanta(quality)
    planes = _planes(np.asarray(values, float).reshape(height, width, channels))
    parts = [_coefficients(p, table).tolist() for p in planes]
    before, bits = [0] * len(parts), []
    for blocks in zip(*parts):
        for k, block in enumerate(blocks):
            bits.append(_bits(block, before[k]))
            before[k] = block[0]
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    body = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00") if stream else b""
    kinds = range(1, len(parts) + 1)
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
            _segment(0xDB, b"\x00" + bytes(table.astype(np.uint8).ravel()[ORDER].tolist())),
            _segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([k, 0x11, 0]) for k in kinds)),
            _code_table(0x00, DC_SYMBOLS, 4),
            _code_table(0x10, AC_SYMBOLS, 8),
            _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([k, 0]) for k in kinds) + b"\x00\x3f\x00"),
            body,
            b"\xff\xd9",
        ]
    )
