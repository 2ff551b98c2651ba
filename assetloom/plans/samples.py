"""Bytes of small media files with given sides and counts, for the queries that read headers."""

from __future__ import annotations

import struct
import zlib


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"


def _profile(linear: bool) -> bytes:
    body = bytearray(128) + struct.pack(">I", 1) + struct.pack(">4sII", b"gTRC", 144, 14) + b"curv" + bytes(4) + struct.pack(">I", 1) + (b"\1\0" if linear else b"\2\x33")
    return b"any name\0\0" + zlib.compress(bytes(body))


def _element(name: bytes, body: bytes) -> bytes:
    return name + bytes([0x40 | len(body) >> 8, len(body) & 255]) + body


def _box(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), name) + body


def _node(name: bytes, props: bytes, n: int, inner: bytes, at: int) -> bytes:
    return struct.pack("<IIIB", at + 13 + len(name) + len(props) + len(inner), n, len(props), len(name)) + name + props + inner


def _array(kind: str, values: list) -> bytes:
    raw = struct.pack(f"<{len(values)}{kind}", *values)
    packed = zlib.compress(raw)
    return kind.encode() + struct.pack("<III", len(values), 1, len(packed)) + packed


def media(k: int, size: int) -> tuple[str, bytes]:
    """Extension and bytes of the k-th file; sides and counts follow from k and size (1 to 50)."""
    n = k % 9
    if n == 0:
        return "svg", f'<?xml version="1.0"?><svg width="{size}px" height="{size + 1}"/>'.encode()
    if n == 1:  # sides that are shares: the box counts
        return "svg", f'<svg height="50%" width="100%" viewBox="0 0 {size} {size + 2}"></svg>'.encode()
    if n == 2:
        head = bytearray(128)
        head[:4] = b"DDS "
        struct.pack_into("<II", head, 12, size + 3, size)
        struct.pack_into("<I", head, 28, size % 4)
        struct.pack_into("<I4s", head, 80, 4, (b"DXT1", b"DXT5", b"DX10")[k % 3])
        return "dds", bytes(head) + struct.pack("<I", 98) * 5
    if n in (3, 4):
        color = _chunk(b"sRGB", b"\0") if k % 2 else _chunk(b"iCCP", _profile(n == 3))
        return "png", b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", size, size + 4, 8, 2, 0, 0, 0)) + color + _chunk(b"IDAT", b"")
    if n == 5:
        info = _element(b"\x15\x49\xa9\x66", _element(b"\x2a\xd7\xb1", (1_000_000).to_bytes(3, "big")) + _element(b"\x44\x89", struct.pack(">d", 500.0 * size)))
        video = _element(b"\xe0", _element(b"\xb0", size.to_bytes(2, "big")) + _element(b"\xba", (size + 5).to_bytes(2, "big")))
        track = _element(b"\x16\x54\xae\x6b", _element(b"\xae", _element(b"\x83", b"\1") + _element(b"\x86", b"V_VP9") + video))
        return "webm", _element(b"\x1a\x45\xdf\xa3", b"") + _element(b"\x18\x53\x80\x67", info + track)
    if n == 6:
        table = _box(b"stbl", _box(b"stsz", struct.pack(">III", 0, 0, 50)) + _box(b"stsd", bytes(12) + b"avc1"))
        media_box = _box(b"mdia", _box(b"hdlr", bytes(8) + b"vide") + _box(b"mdhd", bytes(12) + struct.pack(">II", 600, 1200)) + _box(b"minf", table))
        track = _box(b"trak", _box(b"tkhd", bytes(76) + struct.pack(">II", size << 16, (size + 6) << 16)) + media_box)
        return "mp4", _box(b"moov", _box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 500 * size)) + track)
    if n == 7:
        at = 27 + 13 + len(b"Objects")
        inner = at + 13 + len(b"Geometry")
        corners = [c for f in range(size) for c in (f, f + 1, -f - 3)]
        points = _node(b"Vertices", _array("d", [0.0] * (3 * (size + 2))), 1, b"", inner)
        faces = _node(b"PolygonVertexIndex", _array("i", corners), 1, b"", inner + len(points))
        geometry = _node(b"Geometry", b"", 0, points + faces, at)
        return "fbx", b"Kaydara FBX Binary  \0\x1a\0" + struct.pack("<I", 7400) + _node(b"Objects", b"", 0, geometry, 27) + bytes(13)
    tags = struct.pack("<HHIHH", 256, 3, 1, size, 0) + struct.pack("<HHII", 257, 4, 1, size + 8) + struct.pack("<HHIHH", 277, 3, 1, 3, 0)
    return "tif", b"II*\0\x08\0\0\0" + struct.pack("<H", 3) + tags
