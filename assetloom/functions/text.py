"""Column functions over names, paths and report cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds by extension, and authoring tools by extension.
ASSET_TYPES = {
    "texture": "png jpg jpeg tga psd psb tiff tif exr hdr webp dds bmp gif svg spp sbs",
    "model": "fbx obj gltf glb blend dae 3ds max vox ma mb ztl zpr lxo hip hipnc hiplc c4d zprj",
    "audio": "wav mp3 ogg flac aiff aac wma",
    "video": "mp4 mov m4v webm mkv avi",
    "prefab": "prefab",
    "scene": "unity tscn",
    "material": "mat",
    "animation": "controller anim",
    "script": "cs js gd",
    "data": "asset json xml yaml csv tres",
}
DCC_TOOLS = {
    "blender": "blend", "maya_ascii": "ma", "maya_binary": "mb", "max": "max", "zbrush": "ztl zpr", "substance_painter": "spp",
    "substance_designer": "sbs", "marvelous": "zprj", "photoshop": "psd psb", "modo": "lxo", "houdini": "hip hipnc hiplc", "cinema4d": "c4d",
}
RESERVED_STEMS = ["CON", "PRN", "AUX", "NUL", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10))]


def _lookup(ext: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for name, exts in table.items() for e in exts.split() for x in (e, name)]
    return F.coalesce(F.create_map(*pairs)[F.lower(ext)], default)


def asset_type(ext: Column) -> Column:
    """The kind of a file by its extension, case ignored; `other` where none is known."""
    return F.coalesce(_lookup(ext, ASSET_TYPES, F.lit("other")), F.lit("other"))


def dcc_tool(ext: Column) -> Column:
    """The authoring tool that writes such files, or null."""
    return _lookup(ext, DCC_TOOLS, F.lit(None).cast("string"))


def stem(name: Column) -> Column:
    """The name up to its last dot; all of it without a dot."""
    return F.regexp_replace(name, r"(?s)\.[^.]*$", "")


def dotted_extension(name: Column) -> Column:
    """The last dot and what follows, or the empty string."""
    return F.regexp_extract(name, r"(?s)(\.[^.]*)$", 1)


def extension(name: Column) -> Column:
    """What follows the last dot; a leading dot alone begins no extension. '' if there is none."""
    return F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_sidecar(name: Column) -> Column:
    """Companion files of the engines: .meta, .import, .uid (case counts)."""
    return name.endswith(".meta") | name.endswith(".import") | name.endswith(".uid")


def relative_path(path: Column, root: str) -> Column:
    """The path below root, case ignored; root itself by its last component; others unchanged."""
    r = root.rstrip("/")
    return F.when(F.lower(path) == r.lower(), base_name(path)).when(F.lower(path).startswith(r.lower() + "/"), F.substring(path, len(r) + 2, 1 << 30)).otherwise(path)


def power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def floor_power_of_two(x: Column) -> Column:
    """The largest power of two up to x (x at least 1)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x)) - 1)


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB (one decimal) or GB (two)."""
    k = 1024
    return (
        F.when(n < k, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < k**2, F.concat(F.call_function("format_number", n / k, F.lit("0.0")), F.lit(" KB")))
        .when(n < k**3, F.concat(F.call_function("format_number", n / k**2, F.lit("0.0")), F.lit(" MB")))
        .otherwise(F.concat(F.call_function("format_number", n / k**3, F.lit("0.00")), F.lit(" GB")))
    )


def csv_cell(text: Column) -> Column:
    """A quoted CSV cell; one that a spreadsheet would run as a formula gets an apostrophe."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def render(template: Column, args: Column) -> Column:
    """template with each {{name}} (spaces around the name allowed) of the map args put in; unknown names stay as they are.

    The template is cut at its places once, so what is put in is not looked at again.
    """
    place = r"\{\{\s*[A-Za-z0-9_]+\s*\}\}"
    found = F.regexp_extract_all(template, F.lit(place), F.lit(0))
    value = lambda m: F.coalesce(F.try_element_at(args, F.regexp_extract(m, r"([A-Za-z0-9_]+)", 1)), m)
    parts = F.zip_with(F.split(template, place, -1), found, lambda t, m: F.concat(t, F.coalesce(F.when(m.isNotNull(), value(m)), F.lit(""))))
    return F.array_join(parts, "")


def age(seconds: Column) -> Column:
    """Seconds in their largest whole unit: 42s, 7m, 5h, 3d."""
    unit = lambda n, sign: F.concat(F.floor(seconds / n).cast("string"), F.lit(sign))
    return F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def case_words(text: Column) -> Column:
    """Words for case conversion: cut at _ - space and before an upper letter after a lower one or a digit."""
    marked = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")
    return F.filter(F.split(marked, "[_ -]+"), lambda w: w != "")


def sound_words(text: Column) -> Column:
    """Lower-case words of a sound's name: cut at other than letters and digits, and at case seams."""
    marked = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.transform(F.split(marked, r"[^\p{L}\p{N}]+"), F.lower), lambda w: w != "")


_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{_CJK}]")


def tag_words(text: Column) -> Column:
    """Words for tags: cut at _ - . space, before upper after lower, and between CJK and other letters; A-Z lowered."""
    marked = F.regexp_replace(text, rf"(?<=\p{{Ll}})(?=\p{{Lu}})|(?<=[{_CJK}])(?=[^{_CJK}])|(?<=[^{_CJK}])(?=[{_CJK}])", " ")
    lowered = F.translate(marked, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[_\-. ]+"), lambda w: w != "")


def capitalised(word: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def stable_colour(name: Column, palette: list[str]) -> Column:
    """A palette entry by the 32-bit FNV-1a hash of the name's UTF-8 bytes."""
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.length(F.hex(F.encode(name, "UTF-8"))) / 2, F.lit(1)).cast("int")), lambda i: F.coalesce(F.conv(F.substring(F.hex(F.encode(name, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"), F.lit(0)))
    mask = F.lit((1 << 32) - 1)
    value = F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(mask))
    return F.element_at(F.array(*map(F.lit, palette)), (F.pmod(value, F.lit(len(palette))) + 1).cast("int"))


def name_problem(name: Column) -> Column:
    """Why a new file name can't be used, or null: empty, separator, ending or reserved."""
    return (
        F.when(name.isin("", ".", ".."), "empty")
        .when(name.rlike(r"[/\\]"), "separator")
        .when(name.rlike(r"[ .]$"), "ending")
        .when(F.upper(F.substring_index(name, ".", 1)).isin(RESERVED_STEMS), "reserved")
    )


# The four words that a SipHash state begins with.
_SIP = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)


def siphash(data: list[bytes], key: tuple[int, int] = (0, 0), rounds: tuple[int, int] = (1, 3)) -> np.ndarray:
    """64-bit SipHash of each of the byte strings: (1, 3) or (2, 4) rounds a word and at the end. Works on all of them at a time."""
    word = lambda x: np.uint64(x & 0xFFFFFFFFFFFFFFFF)
    size = np.array([len(d) for d in data], np.int64)
    words = size // 8 + 1  # the last one holds what is left and the length
    block = np.zeros((len(data), 8 * int(words.max(initial=1))), np.uint8)
    for i, d in enumerate(data):
        block[i, : len(d)] = np.frombuffer(d, np.uint8)
        block[i, 8 * words[i] - 1] = len(d) & 255
    block = block.view("<u8")
    v = [np.full(len(data), word(s ^ key[i % 2])) for i, s in enumerate(_SIP)]
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mix(v: list[np.ndarray], n: int) -> list[np.ndarray]:
        a, b, c, d = v
        for _ in range(n):
            a, c = a + b, c + d
            b, d = turn(b, 13) ^ a, turn(d, 16) ^ c
            a, c = turn(a, 32) + d, c + b
            b, d = turn(b, 17) ^ c, turn(d, 21) ^ a
            c = turn(c, 32)
        return [a, b, c, d]

    for w in range(block.shape[1]):
        m, on = block[:, w], words > w
        mixed = mix([v[0], v[1], v[2], v[3] ^ m], rounds[0])
        mixed[0] = mixed[0] ^ m
        v = [np.where(on, x, y) for x, y in zip(mixed, v, strict=True)]
    v[2] = v[2] ^ word(255)
    a, b, c, d = mix(v, rounds[1])
    return a ^ b ^ c ^ d


def seeded_rank(path: Column, seed: int = 0) -> Column:
    """The rank of a path for a seed: SipHash-1-3 with a key of zeros over the seed (8 bytes, low first), the path and 0xFF, in unsigned order."""
    head = (seed & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")

    @F.pandas_udf("long")
    def ranks(paths: pd.Series) -> pd.Series:
        hashes = siphash([head + (p or "").encode() + b"\xff" for p in paths])
        return pd.Series((hashes ^ np.uint64(1 << 63)).view(np.int64))  # signed numbers then have the unsigned order

    return ranks(path)
