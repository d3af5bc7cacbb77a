"""Codecs over bytes: LZ4 blocks, Zstandard, run lengths, Windows-1252 and textures. Pure functions for use inside Arrow batches."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard

_lz4 = pa.Codec("lz4_raw")


def lz4_block(data: bytes) -> bytes:
    return _lz4.compress(data, asbytes=True)


def lz4_unblock(data: bytes, size: int) -> bytes:
    out = _lz4.decompress(data, decompressed_size=size, asbytes=True)
    if len(out) != size:
        raise ValueError(f"block holds {len(out)} bytes, not {size}")
    return out


def zstd(data: bytes, level: int = 6) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unzstd(data: bytes, most: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=most)


def run_lengths(pairs: bytes, blocks: list[tuple[int, int]], most: int = 1 << 30) -> bytes:
    """Runs of stored bytes, each followed by so many zeros, `most` bytes in all at most."""
    if sum(stored + zeros for stored, zeros in blocks) > most:
        raise ValueError(f"runs make more than {most} bytes")
    out, at = bytearray(), 0
    for stored, zeros in blocks:
        if at + stored > len(pairs):
            raise ValueError("run reaches past the data")
        out += pairs[at : at + stored] + bytes(zeros)
        at += stored
    return bytes(out)


#: The code points of bytes 0x80 to 0x9F; the five that code page leaves open map to control characters.
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_to_byte = {c: 0x80 + i for i, c in enumerate(WINDOWS_1252)}


def from_windows_1252(data: bytes) -> str:
    return "".join(WINDOWS_1252[b - 0x80] if 0x80 <= b < 0xA0 else chr(b) for b in data)


def to_windows_1252(text: str) -> bytes:
    """Characters the code page lacks become question marks."""
    return bytes(_to_byte.get(c, ord(c) if ord(c) < 0x80 or 0xA0 <= ord(c) < 0x100 else ord("?")) for c in text)


def colours_565(c: np.ndarray) -> np.ndarray:
    """RGB of 16-bit colours, each channel spread over 0 to 255 and rounded."""
    parts = []
    for shift, bits in ((11, 5), (5, 6), (0, 5)):
        t = (c >> shift & (1 << bits) - 1) * 255 + (1 << bits - 1)
        parts.append((t >> bits) + t >> bits)
    return np.stack(parts, axis=-1).astype(np.int32)


def blocks_of(width: int, height: int, data: bytes, size: int) -> np.ndarray:
    """A texture's four-by-four blocks, a row of so many bytes each; the last ones of a side may reach past it."""
    n = -(-width // 4) * -(-height // 4) * size
    if len(data) < n:
        raise ValueError("texture is short")
    return np.frombuffer(data[:n], dtype=np.uint8).reshape(-1, size).astype(np.uint32)


def laid_out(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    wide, high = -(-width // 4), -(-height // 4)
    return pixels.reshape(high, wide, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(4 * high, 4 * wide, 4)[:height, :width].astype(np.uint8)


def dxt1(width: int, height: int, data: bytes) -> np.ndarray:
    """RGBA pixels of a texture of four-by-four blocks with two end colours; a first colour not above the second has one
    mean and one clear entry."""
    b = blocks_of(width, height, data, 8)
    c0, c1 = b[:, 0] | b[:, 1] << 8, b[:, 2] | b[:, 3] << 8
    p0, p1 = colours_565(c0), colours_565(c1)
    four = (c0 > c1)[:, None]
    table = np.zeros((len(b), 4, 4), dtype=np.int32)
    table[:, :, 3] = 255
    table[:, 0, :3], table[:, 1, :3] = p0, p1
    table[:, 2, :3] = np.where(four, (2 * p0 + p1) // 3, (p0 + p1) // 2)
    table[:, 3, :3] = np.where(four, (p0 + 2 * p1) // 3, 0)
    table[:, 3, 3] = np.where(four[:, 0], 255, 0)
    bits = b[:, 4] | b[:, 5] << 8 | b[:, 6] << 16 | b[:, 7] << 24
    pick = (bits[:, None] >> np.arange(0, 32, 2, dtype=np.uint32)) & 3
    return laid_out(table[np.arange(len(b))[:, None], pick], width, height)


def unswizzle(width: int, height: int, data: bytes, pixel: int) -> np.ndarray:
    """Pixels of so many bytes laid out along a Morton curve, x in the even bits as far as both sides reach."""
    if width & (width - 1) or height & (height - 1) or len(data) < width * height * pixel:
        raise ValueError("sides must be powers of two and the data whole")
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    at, bit, shift = np.zeros_like(x), 1, 0
    while bit < max(width, height):
        if bit < width:
            at |= ((x & bit) > 0).astype(at.dtype) << shift
            shift += 1
        if bit < height:
            at |= ((y & bit) > 0).astype(at.dtype) << shift
            shift += 1
        bit <<= 1
    return np.frombuffer(data[: width * height * pixel], dtype=np.uint8).reshape(-1, pixel)[at]


def dxt3(width: int, height: int, data: bytes) -> np.ndarray:
    """As dxt1 with four colours always, and four bits of opacity a pixel before each block's colours."""
    b = blocks_of(width, height, data, 16)
    p0, p1 = colours_565(b[:, 8] | b[:, 9] << 8), colours_565(b[:, 10] | b[:, 11] << 8)
    table = np.stack([p0, p1, (2 * p0 + p1) // 3, (p0 + 2 * p1) // 3], axis=1)
    bits = b[:, 12] | b[:, 13] << 8 | b[:, 14] << 16 | b[:, 15] << 24
    pick = (bits[:, None] >> np.arange(0, 32, 2, dtype=np.uint32)) & 3
    clear = np.stack([b[:, :8] & 15, b[:, :8] >> 4], axis=-1).reshape(-1, 16) * 17
    pixels = np.concatenate([table[np.arange(len(b))[:, None], pick], clear[..., None]], axis=-1)
    return laid_out(pixels, width, height)


def from_words(words: np.ndarray, code: int) -> np.ndarray:
    """RGBA of 16-bit pixels: 4 is 4-4-4-4, 5 is 5-6-5; channels are shifted up, low bits left zero."""
    w = words.astype(np.uint32)
    if code == 4:
        parts = [(w >> 8 & 15) << 4, (w >> 4 & 15) << 4, (w & 15) << 4, (w >> 12) << 4]
    else:
        parts = [(w >> 11) << 3, (w >> 5 & 63) << 2, (w & 31) << 3, np.full_like(w, 255)]
    return np.stack(parts, axis=-1).astype(np.uint8)


def xpr_pixels(data: bytes, most: int = 1024) -> np.ndarray:
    """RGBA pixels of a packed resource of one texture: square, of a power of two up to most."""
    if len(data) < 36 or data[:4] != b"XPR0":
        raise ValueError("no texture resource")
    size, header, flags, offset, unknown = struct.unpack_from("<IIIII", data, 4)
    code, power, sides, end = data[25], data[27], *struct.unpack_from("<II", data, 28)
    if flags & 0xFFFF != 1 or flags >> 16 & 7 != 4 or offset or unknown or sides or end != 0xFFFFFFFF:
        raise ValueError("resource isn't one square texture")
    if power > 31 or (side := 1 << power) > most or header > min(size, len(data)):
        raise ValueError("texture is too large or cut off")
    body = data[header : min(size, len(data))]
    if code == 0x0C:
        return dxt1(side, side, body)
    if code == 0x0E:
        return dxt3(side, side, body)
    if code in (4, 5):
        return from_words(unswizzle(side, side, body, 2).copy().view("<u2")[..., 0], code)
    if code in (6, 7):
        bgra = unswizzle(side, side, body, 4)
        out = bgra[..., [2, 1, 0, 3]].copy()
        if code == 7:
            out[..., 3] = 255
        return out
    if code == 0x3C:
        return unswizzle(side, side, body, 4)[..., ::-1].copy()
    raise ValueError(f"texture format {code} isn't known")


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of RGBA pixels."""
    height, width, _ = pixels.shape
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(pixels, dtype=np.uint8))
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
