"""Evidence files written with zlib and struct only."""

from __future__ import annotations

import struct
import zlib


def png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width: int, height: int, pixel, channels: int = 3, texts: dict[str, str] | None = None) -> bytes:
    """``pixel(y, x)`` gives a tuple of channel values in R, G, B[, A] or gray order."""
    ctype = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\x00" + bytes(v for x in range(width) for v in pixel(y, x)) for y in range(height))
    out = b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, ctype, 0, 0, 0))
    for key, value in (texts or {}).items():
        out += png_chunk(b"tEXt", key.encode("latin-1") + b"\x00" + value.encode("latin-1"))
    return out + png_chunk(b"IDAT", zlib.compress(raw)) + png_chunk(b"IEND", b"")


def quantiser(quality: int, base: list[int]) -> list[int]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [max(1, min(255, int((q * scale + 50) // 100))) for q in base]


def jpeg_head(tables: list[tuple[int, list[int], int]], comment: str = "") -> bytes:
    """SOI, APP0, COM, DQT (table id, values, precision bits), EOI; no pixels."""
    out = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\x00\x01\x02\x00\x00\x01\x00\x01\x00\x00"
    if comment:
        body = comment.encode()
        out += b"\xff\xfe" + struct.pack(">H", len(body) + 2) + body
    for ident, values, bits in tables:
        body = bytes([(0x10 if bits == 16 else 0) | ident]) + struct.pack(f">64{'H' if bits == 16 else 'B'}", *values)
        out += b"\xff\xdb" + struct.pack(">H", len(body) + 2) + body
    return out + b"\xff\xd9"
