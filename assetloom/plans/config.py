"""Rule configuration: one dataclass a section, read from TOML; unknown keys in a section are errors."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields

MIB = 1 << 20


@dataclass(frozen=True)
class Naming:
    enabled: bool = True
    # Characters that file names should not hold.
    forbidden_chars: tuple[str, ...] = tuple(" !#$%^&*()+=<>:\"|?")
    forbid_chinese: bool = False
    max_length: int = 512
    texture_prefix: str | None = None
    model_prefix: str | None = None
    audio_prefix: str | None = None
    case_style: str = "any"


@dataclass(frozen=True)
class Texture:
    enabled: bool = False
    require_pot: bool = True
    max_size: int = 4096
    min_size: int = 4
    warn_non_square: bool = False
    max_file_size: int = 10 * MIB
    color_space: bool = True


@dataclass(frozen=True)
class Model:
    enabled: bool = False
    max_vertices: int = 100_000
    max_faces: int = 100_000
    max_materials: int = 10


@dataclass(frozen=True)
class Audio:
    enabled: bool = False
    allowed_sample_rates: tuple[int, ...] = (44100, 48000)
    max_sfx_duration: float = 30.0
    max_file_size: int = 20 * MIB
    warn_stereo_sfx: bool = False


@dataclass(frozen=True)
class PbrSet:
    enabled: bool = False
    trigger: str = "basecolor"
    required: tuple[str, ...] = ("basecolor", "normal")
    # The texture suffixes of each channel, and of packed textures.
    channels: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "basecolor": ("BaseColor", "Albedo", "Diffuse", "Color"), "normal": ("Normal", "Norm"), "roughness": ("Roughness", "Rough"), "metallic": ("Metallic", "Metal"),
        "ao": ("AO", "AmbientOcclusion"), "emissive": ("Emissive", "Emission"), "height": ("Height", "Disp"),
    })
    packed: dict[str, tuple[str, ...]] = field(default_factory=lambda: {x: ("ao", "roughness", "metallic") for x in ("ORM", "MRA", "RMA")})


@dataclass(frozen=True)
class DccSource:
    enabled: bool = False
    mtime_tolerance_secs: int = 60
    same_dir: bool = True
    sibling_dirs: tuple[str, ...] = ("sources", "_source", "src")
    # Source extensions and the exports made from them.
    mappings: tuple[tuple[str, str, str], ...] = (
        ("blender", "blend", "fbx glb gltf obj dae"), ("maya", "ma mb", "fbx obj"), ("max", "max", "fbx obj"), ("zbrush", "ztl zpr", "obj fbx"), ("modo", "lxo", "fbx obj"),
        ("houdini", "hip hipnc hiplc", "fbx obj abc usd"), ("cinema4d", "c4d", "fbx obj"), ("marvelous", "zprj", "obj fbx"),
        ("substance_painter", "spp", "png tga jpg tif tiff exr"), ("substance_designer", "sbs", "sbsar png tga"), ("photoshop", "psd psb", "png jpg tga webp"),
    )


@dataclass(frozen=True)
class RuleConfig:
    naming: Naming = Naming()
    texture: Texture = Texture()
    model: Model = Model()
    audio: Audio = Audio()
    pbr_set: PbrSet = field(default_factory=PbrSet)
    dcc_source: DccSource = DccSource()
    #: Whether exact copies and broken references are reported.
    duplicate: bool = True
    missing_reference: bool = True
    #: Globs over paths below the root; * and ? also cross /.
    ignore: tuple[str, ...] = ()


def _frozen(value):
    if isinstance(value, list):
        return tuple(_frozen(x) for x in value)
    return {k: _frozen(v) for k, v in value.items()} if isinstance(value, dict) else value


def load(toml: str) -> RuleConfig:
    """The configuration of a TOML text; missing keys have their defaults, unknown ones raise ValueError."""
    given, out = tomllib.loads(toml), {}
    kinds = {"naming": Naming, "texture": Texture, "model": Model, "audio": Audio, "pbr_set": PbrSet, "dcc_source": DccSource}
    for name, section in given.items():
        if name in kinds:
            unknown = set(section) - {f.name for f in fields(kinds[name])}
            if unknown:
                raise ValueError(f"[{name}]: unknown {', '.join(sorted(unknown))}")
            out[name] = kinds[name](**{k: _frozen(v) for k, v in section.items()})
        elif name in ("duplicate", "missing_reference"):
            out[name] = bool(section.get("enabled", True))
        elif name == "ignore":
            out[name] = tuple(section.get("patterns", ()))
    return RuleConfig(**out)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regex: ** and * and ? cross /, [..] and {a,b} as usual; ValueError if malformed."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 2
        elif c == "*":
            out.append(".*")
            while pattern[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed [ in {pattern!r}")
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                raise ValueError(f"unopened }} in {pattern!r}")
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in {pattern!r}")
    return "(?s)^" + "".join(out) + "$"
