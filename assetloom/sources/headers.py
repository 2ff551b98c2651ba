"""Small header readers: bytes of a file to what its kind's header says. None or {} where unreadable."""

from __future__ import annotations

import json
import re
import struct
import zlib

#: Bytes of a file that the readers may look at.
HEAD_BYTES = 1 << 20


def _png(b: bytes) -> dict:
    if b[:8] != b"\x89PNG\r\n\x1a\n" or b[12:16] != b"IHDR":
        return {}
    w, h, _, kind = struct.unpack(">IIBB", b[16:26])
    out, at, alpha = {"width": w, "height": h}, 8, kind in (4, 6)
    for _ in range(64):
        if at + 8 > len(b):
            break
        size, name = struct.unpack(">I4s", b[at : at + 8])
        body = b[at + 8 : at + 8 + size]
        if name == b"sRGB":
            out["color_space"] = "sRGB"
        elif name == b"iCCP" and "color_space" not in out:
            out["color_space"] = _icc_space(body)
        elif name == b"tRNS":
            alpha = True
        elif name == b"IDAT":
            break
        at += 12 + size
    return out | {"has_alpha": alpha}


def _icc_space(chunk: bytes) -> str | None:
    """Linear if every tone curve of the profile is the identity or gamma 1; else sRGB; null if unreadable."""
    try:
        profile = zlib.decompressobj().decompress(chunk[chunk.index(b"\0") + 2 :], 4 << 20)
        count = struct.unpack(">I", profile[128:132])[0]
        linear = []
        for i in range(min(count, 100)):
            tag, at, _ = struct.unpack(">4sII", profile[132 + 12 * i : 144 + 12 * i])
            if tag in (b"rTRC", b"gTRC", b"bTRC", b"kTRC"):
                kind, n = profile[at : at + 4], struct.unpack(">I", profile[at + 8 : at + 12])[0]
                if kind == b"curv":
                    linear.append(n == 0 or n == 1 and profile[at + 12 : at + 14] == b"\x01\x00")
                elif kind == b"para":
                    linear.append(profile[at + 8 : at + 10] == b"\0\0" and profile[at + 12 : at + 16] == b"\0\x01\0\0")
    except (ValueError, zlib.error, struct.error):
        return None
    if linear:
        return "Linear" if all(linear) else "sRGB"
    return "Linear" if b"inear" in profile else "sRGB" if b"sRGB" in profile else None


def _jpg(b: bytes) -> dict:
    at = 2
    while b[:2] == b"\xff\xd8" and at + 9 < len(b):
        if b[at] != 0xFF:
            return {}
        kind, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return {"width": w, "height": h, "has_alpha": False}
        at += 1 if kind == 0xFF else 2 + size
    return {}


def _bmp(b: bytes) -> dict:
    if b[:2] != b"BM" or len(b) < 30:
        return {}
    w, h, _, bits = struct.unpack("<iiHH", b[18:30])
    return {"width": abs(w), "height": abs(h), "has_alpha": bits == 32}


def _gif(b: bytes) -> dict:
    return dict(zip(("width", "height"), struct.unpack("<HH", b[6:10]), strict=True)) | {"has_alpha": True} if b[:4] == b"GIF8" else {}


def _tga(b: bytes) -> dict:
    return {"width": struct.unpack("<H", b[12:14])[0], "height": struct.unpack("<H", b[14:16])[0], "has_alpha": b[16] in (16, 32) and bool(b[17] & 15)} if len(b) >= 18 and b[2] in (1, 2, 3, 9, 10, 11) else {}


def _webp(b: bytes) -> dict:
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP":
        return {}
    if b[12:16] == b"VP8X":
        return {"width": 1 + int.from_bytes(b[24:27], "little"), "height": 1 + int.from_bytes(b[27:30], "little"), "has_alpha": bool(b[20] & 16)}
    if b[12:16] == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF), "has_alpha": bool(bits >> 28 & 1)}
    return {"width": struct.unpack("<H", b[26:28])[0] & 0x3FFF, "height": struct.unpack("<H", b[28:30])[0] & 0x3FFF, "has_alpha": False}


def _hdr(b: bytes) -> dict:
    m = re.search(rb"[-+]Y (\d+) [-+]X (\d+)", b[:4096]) if b[:2] == b"#?" else None
    return {"width": int(m[2]), "height": int(m[1]), "has_alpha": False} if m else {}


def _dds(b: bytes) -> dict:
    if b[:4] != b"DDS " or len(b) < 128:
        return {}
    h, w = struct.unpack("<II", b[12:20])
    mips, flags, four = struct.unpack("<I", b[28:32])[0], struct.unpack("<I", b[80:84])[0], b[84:88]
    # Compressed formats with an alpha channel, and those numbers of the longer header.
    alpha = four in (b"DXT2", b"DXT3", b"DXT4", b"DXT5") if flags & 4 else bool(flags & 3)
    if four == b"DX10" and len(b) >= 132:
        alpha = struct.unpack("<I", b[128:132])[0] in (2, 10, 28, 29, 73, 74, 75, 76, 77, 78, 87, 91, 97, 98, 99)
    return {"width": w, "height": h, "has_alpha": alpha, "mipmap_count": max(mips, 1)}


def _svg(b: bytes) -> dict:
    m = re.search(r"<svg\b[^>]*>", b[: 16 << 10].decode("utf-8", "replace"))
    if not m:
        return {}
    sides = [re.search(rf"\s{k}\s*=\s*[\"']\s*([0-9.]+)(?:px)?\s*[\"']", m[0]) for k in ("width", "height")]
    if all(sides):
        w, h = (float(x[1]) for x in sides)
    else:
        box = re.search(r"\sviewBox\s*=\s*[\"']\s*[-0-9.]+[ ,]+[-0-9.]+[ ,]+([0-9.]+)[ ,]+([0-9.]+)", m[0])
        if not box:
            return {}
        w, h = float(box[1]), float(box[2])
    return {"width": round(w), "height": round(h), "has_alpha": True}


def _wav(b: bytes) -> dict:
    if b[:4] != b"RIFF" or b[8:12] != b"WAVE":
        return {}
    out, at, per_second = {}, 12, 0
    while at + 8 <= len(b):
        name, size = struct.unpack("<4sI", b[at : at + 8])
        if name == b"fmt ":
            _, channels, rate, per_second, _, bits = struct.unpack("<HHIIHH", b[at + 8 : at + 24])
            out = {"channels": channels, "sample_rate": rate, "bit_depth": bits}
        elif name == b"data" and per_second:
            return out | {"duration_secs": size / per_second}
        at += 8 + size + size % 2
    return out


def _gltf(b: bytes) -> dict:
    if b[:4] == b"glTF":
        size = struct.unpack("<I", b[12:16])[0]
        b = b[20 : 20 + size]
    doc = json.loads(b)
    count = lambda i: doc["accessors"][i]["count"]
    vertices = faces = 0
    for mesh in doc.get("meshes", ()):
        for p in mesh.get("primitives", ()):
            n = count(p["attributes"]["POSITION"])
            vertices += n
            corners, mode = count(p["indices"]) if "indices" in p else n, p.get("mode", 4)
            faces += corners // 3 if mode == 4 else max(corners - 2, 0) if mode in (5, 6) else 0
    return {"vertex_count": vertices, "face_count": faces, "material_count": len(doc.get("materials", ()))}


def _obj(b: bytes) -> dict:
    """Vertices by distinct corner, faces cut into triangles; materials are counted by material_names of its library."""
    corners, faces = set(), 0
    for line in b.splitlines():
        if line.startswith(b"f "):
            parts = line.split()[1:]
            corners.update(parts)
            faces += max(len(parts) - 2, 0)
    return {"vertex_count": len(corners), "face_count": faces} if faces else {}


def material_names(b: bytes) -> set[bytes]:
    """The materials that an MTL text defines."""
    return {line.split(None, 1)[1].strip() for line in b.splitlines() if line.startswith(b"newmtl ")}


def material_library(b: bytes) -> str | None:
    """The MTL file that an OBJ text names first."""
    found = re.search(rb"(?m)^mtllib[ \t]+(.+?)[ \t\r]*$", b)
    return found[1].decode("utf-8", "replace") if found else None


def _boxes(b: bytes, at: int, end: int):
    while at + 8 <= end:
        size, name = struct.unpack(">I4s", b[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", b[at + 8 : at + 16])[0], 16
        size = size or end - at
        if size < head:
            return
        yield name, at + head, min(at + size, end)
        at += size


def _inside(b: bytes, path: list[bytes], at: int, end: int):
    for name, i, j in _boxes(b, at, end):
        if name == path[0]:
            if len(path) == 1:
                yield i, j
            else:
                yield from _inside(b, path[1:], i, j)


def _mp4(b: bytes) -> dict:
    out: dict = {}
    for i, _ in _inside(b, [b"moov", b"mvhd"], 0, len(b)):
        scale, length = struct.unpack(">IQ", b[i + 20 : i + 32]) if b[i] else struct.unpack(">II", b[i + 12 : i + 20])
        out["duration_secs"] = length / scale if scale else None
    for i, j in _inside(b, [b"moov", b"trak"], 0, len(b)):
        if any(b[k + 8 : k + 12] == b"vide" for k, _ in _inside(b, [b"mdia", b"hdlr"], i, j)):
            for k, e in _inside(b, [b"tkhd"], i, j):
                w, h = struct.unpack(">II", b[e - 8 : e])
                out |= {"width": w >> 16, "height": h >> 16}
            for k, _ in _inside(b, [b"mdia", b"minf", b"stbl", b"stsd"], i, j):
                out["video_codec"] = b[k + 12 : k + 16].decode("latin-1").strip()
            out["framerate"] = _frame_rate(b, i, j)
            break
    return out


def _frame_rate(b: bytes, at: int, end: int) -> float | None:
    """Samples of a track over its own length."""
    seconds = samples = 0.0
    for i, _ in _inside(b, [b"mdia", b"mdhd"], at, end):
        scale, length = struct.unpack(">IQ", b[i + 20 : i + 32]) if b[i] else struct.unpack(">II", b[i + 12 : i + 20])
        seconds = length / scale if scale else 0.0
    for i, _ in _inside(b, [b"mdia", b"minf", b"stbl", b"stsz"], at, end):
        samples = struct.unpack(">I", b[i + 8 : i + 12])[0]
    return samples / seconds if seconds and samples else None


def _tiff(b: bytes) -> dict:
    order = {b"II": "<", b"MM": ">"}.get(b[:2])
    if not order or struct.unpack(order + "H", b[2:4])[0] != 42:
        return {}
    at = struct.unpack(order + "I", b[4:8])[0]
    values = {}
    for i in range(struct.unpack(order + "H", b[at : at + 2])[0]):
        field = b[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind = struct.unpack(order + "HH", field[:4])
        values[tag] = struct.unpack(order + "H", field[8:10])[0] if kind == 3 else struct.unpack(order + "I", field[8:12])[0]
    if 256 not in values or 257 not in values:
        return {}
    return {"width": values[256], "height": values[257], "has_alpha": values.get(277, 1) in (2, 4)}


def _exr(b: bytes) -> dict:
    if b[:4] != b"\x76\x2f\x31\x01":
        return {}
    at, out = 8, {}
    while b[at : at + 1] not in (b"\0", b""):
        name, kind, rest = b[at:].split(b"\0", 2) if at + 512 > len(b) else b[at : at + 512].split(b"\0", 2)
        at += len(name) + len(kind) + 2
        size = struct.unpack("<I", b[at : at + 4])[0]
        body = b[at + 4 : at + 4 + size]
        at += 4 + size
        if name == b"dataWindow":
            x0, y0, x1, y1 = struct.unpack("<4i", body)
            out |= {"width": x1 - x0 + 1, "height": y1 - y0 + 1}
        elif name == b"channels":
            names, i = [], 0
            while i < len(body) and body[i]:
                end = body.index(b"\0", i)
                names.append(body[i:end])
                i = end + 17
            out["has_alpha"] = b"A" in names
    return out if "width" in out else {}


def _fbx_nodes(b: bytes, at: int, end: int, wide: bool):
    """Name, properties' place and number, and children's range of each node of a binary file."""
    head = struct.Struct("<QQQB" if wide else "<IIIB")
    while at + head.size <= end:
        stop, n, size, name = head.unpack_from(b, at)
        if not stop:
            return
        at += head.size
        yield b[at : at + name], at + name, n, at + name + size, stop
        at = stop


def _fbx_array(b: bytes, at: int) -> tuple[bytes, bytes, int]:
    """Type letter, bytes and length of an array property."""
    n, packed, size = struct.unpack("<III", b[at + 1 : at + 13])
    body = b[at + 13 : at + 13 + size]
    return b[at : at + 1], zlib.decompress(body) if packed else body, n


def _fbx(b: bytes) -> dict:
    """Vertices are thirds of the coordinates, faces the negative corner numbers; nothing of a text file."""
    if b[:21] != b"Kaydara FBX Binary  \0":
        return {}
    wide = struct.unpack("<I", b[23:27])[0] >= 7500
    vertices = faces = materials = 0
    for top, _, _, inner, end in _fbx_nodes(b, 27, len(b), wide):
        if top != b"Objects":
            continue
        for kind, _, _, body, stop in _fbx_nodes(b, inner, end, wide):
            materials += kind == b"Material"
            if kind != b"Geometry":
                continue
            for name, at, n, _, _ in _fbx_nodes(b, body, stop, wide):
                if n and name == b"Vertices":
                    vertices += _fbx_array(b, at)[2] // 3
                elif n and name == b"PolygonVertexIndex":
                    letter, data, count = _fbx_array(b, at)
                    faces += sum(x < 0 for x in struct.unpack(f"<{count}{'q' if letter == b'l' else 'i'}", data))
    return {"vertex_count": vertices, "face_count": faces, "material_count": materials} if vertices or faces or materials else {}


def _ebml(b: bytes, at: int, end: int):
    """Id, start and end of each element; an element of unknown size goes to the end."""
    while at < end:
        width = 9 - b[at].bit_length()
        if width > 4:
            return
        name = int.from_bytes(b[at : at + width], "big")
        at += width
        if at >= end or not b[at]:
            return
        width = 9 - b[at].bit_length()
        size = int.from_bytes(b[at : at + width], "big") & ((1 << 7 * width) - 1)
        at += width
        stop = end if size == (1 << 7 * width) - 1 else min(at + size, end)
        yield name, at, stop
        at = stop


def _matroska(b: bytes) -> dict:
    """Length in units of the time scale (nanoseconds), and the first video track."""
    number = lambda i, j: int.from_bytes(b[i:j], "big")
    out: dict = {}
    for top, i, j in _ebml(b, 0, len(b)):
        if top != 0x18538067:
            continue
        for part, k, m in _ebml(b, i, j):
            if part == 0x1549A966:
                fields = {name: (x, y) for name, x, y in _ebml(b, k, m)}
                scale = number(*fields[0x2AD7B1]) if 0x2AD7B1 in fields else 1_000_000
                if 0x4489 in fields:
                    x, y = fields[0x4489]
                    out["duration_secs"] = struct.unpack(">f" if y - x == 4 else ">d", b[x:y])[0] * scale / 1e9
            elif part == 0x1654AE6B and "video_codec" not in out:
                for entry, x, y in _ebml(b, k, m):
                    fields = {name: (p, q) for name, p, q in _ebml(b, x, y)} if entry == 0xAE else {}
                    if 0x83 in fields and number(*fields[0x83]) == 1:
                        out["video_codec"] = b[slice(*fields[0x86])].decode("ascii", "replace").rstrip("\0") if 0x86 in fields else None
                        size = {name: number(p, q) for name, p, q in _ebml(b, *fields[0xE0])} if 0xE0 in fields else {}
                        out |= {"width": size.get(0xB0), "height": size.get(0xBA)} if size else {}
                        break
    return out


def _flac(b: bytes) -> dict:
    if b[:4] != b"fLaC":
        return {}
    bits = int.from_bytes(b[18:26], "big")
    rate, total = bits >> 44, bits & ((1 << 36) - 1)
    out = {"sample_rate": rate, "channels": (bits >> 41 & 7) + 1, "bit_depth": (bits >> 36 & 31) + 1}
    return out | ({"duration_secs": total / rate} if total and rate else {})


def _ogg(b: bytes) -> dict:
    """Vorbis and Opus: rate and channels from the first page, the length from the last page's position."""
    if b[:4] != b"OggS":
        return {}
    body = b[27 + b[26] :]
    if body[:7] == b"\x01vorbis":
        out, clock, skip = {"channels": body[11], "sample_rate": struct.unpack("<I", body[12:16])[0]}, struct.unpack("<I", body[12:16])[0], 0
    elif body[:8] == b"OpusHead":
        out, clock, skip = {"channels": body[9], "sample_rate": 48000}, 48000, struct.unpack("<H", body[10:12])[0]
    else:
        return {}
    last = b.rfind(b"OggS")
    end = struct.unpack("<q", b[last + 6 : last + 14])[0]
    return out | ({"duration_secs": (end - skip) / clock} if clock and end > skip and last else {})


# Kilobits a second of layer III by index, version 1 and 2, and sample rates of version 1.
_MP3_RATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_MP3_CLOCKS = (44100, 48000, 32000)


def _mp3(b: bytes) -> dict:
    """The first frame's rate and channels; the length by the frame count of a Xing header, else by the bit rate."""
    at = 0
    if b[:3] == b"ID3":
        at = 10 + sum((b[6 + i] & 127) << 7 * (3 - i) for i in range(4))
    at = next((i for i in range(at, min(len(b) - 4, at + 65536)) if b[i] == 0xFF and b[i + 1] & 0xE6 == 0xE2 and b[i + 2] >> 4 not in (0, 15) and b[i + 2] >> 2 & 3 != 3), None)
    if at is None:
        return {}
    version, mono = b[at + 1] >> 3 & 3, b[at + 3] >> 6 == 3
    clock = _MP3_CLOCKS[b[at + 2] >> 2 & 3] >> (0 if version == 3 else 1 if version == 2 else 2)
    samples = 1152 if version == 3 else 576
    out = {"sample_rate": clock, "channels": 1 if mono else 2}
    side = at + 4 + ((17 if mono else 32) if version == 3 else (9 if mono else 17))
    if b[side : side + 4] in (b"Xing", b"Info") and b[side + 7] & 1:
        return out | {"duration_secs": struct.unpack(">I", b[side + 8 : side + 12])[0] * samples / clock}
    kilobits = _MP3_RATES[3 if version == 3 else 2][b[at + 2] >> 4]
    return out | {"duration_secs": (len(b) - at) * 8 / (kilobits * 1000)}


def _aiff(b: bytes) -> dict:
    if b[:4] != b"FORM" or b[8:12] not in (b"AIFF", b"AIFC"):
        return {}
    at = 12
    while at + 8 <= len(b):
        name, size = struct.unpack(">4sI", b[at : at + 8])
        if name == b"COMM":
            channels, frames, bits, exponent, mantissa = struct.unpack(">hIhHQ", b[at + 8 : at + 26])
            rate = mantissa * 2.0 ** (exponent - 16383 - 63)
            return {"channels": channels, "bit_depth": bits, "sample_rate": round(rate), "duration_secs": frames / rate}
        at += 8 + size + size % 2
    return {}


READERS = {
    "png": _png, "jpg": _jpg, "jpeg": _jpg, "bmp": _bmp, "gif": _gif, "tga": _tga, "webp": _webp, "hdr": _hdr, "dds": _dds, "svg": _svg, "wav": _wav, "gltf": _gltf, "glb": _gltf, "obj": _obj, "mp4": _mp4, "mov": _mp4, "m4v": _mp4,
    "tif": _tiff, "tiff": _tiff, "exr": _exr, "fbx": _fbx, "mkv": _matroska, "webm": _matroska, "mp3": _mp3, "ogg": _ogg, "flac": _flac, "aiff": _aiff,
}
#: Kinds whose readers need the whole file; the others are read up to HEAD_BYTES.
WHOLE = ("gltf", "glb", "obj", "mp4", "mov", "m4v", "fbx", "mp3", "ogg", "tif", "tiff", "wav")
#: A file above this has no header if its kind needs the whole of it.
MOST_BYTES = 256 << 20


def read_header(extension: str, content: bytes) -> dict:
    """What the header says; {} for other kinds and for files that can't be read."""
    reader = READERS.get(extension.lower())
    try:
        return reader(content) if reader and content else {}
    except (struct.error, zlib.error, IndexError, KeyError, ValueError, TypeError, OverflowError, ZeroDivisionError):
        return {}
