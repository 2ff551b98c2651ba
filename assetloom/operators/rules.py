"""Rules over single assets: one pass, no shuffle; at most one issue a family and asset."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.config import Audio, Model, Naming, RuleConfig, Texture, glob_regex

ISSUE = "struct<rule_id:string,severity:string,auto_fixable:boolean,asset_path:string,related_paths:array<string>,args:map<string,string>>"
# Words of sound effects, and name endings of textures that hold data.
SOUND_WORDS = ["sfx", "sound", "effect", "hit", "click", "ui"]
DATA_SUFFIXES = "_n _normal _norm _nrm _rough _roughness _metal _metallic _ao _mask _data _lin _linear _height _disp _displacement _orm _mra _rma".split()

#: The text of each issue; {{name}} stands for an argument.
MESSAGES = {
    "naming.length": "Name has {{length}} characters; {{max}} are allowed",
    "naming.forbidden_char": "Name holds the character '{{char}}'",
    "naming.chinese": "Name holds CJK characters",
    "naming.prefix": "Name lacks the prefix '{{prefix}}'",
    "naming.case": "Name is not in {{style}}",
    "texture.pot": "{{width}}x{{height}} is no power of two; {{next_width}}x{{next_height}} would be",
    "texture.max_size": "{{width}}x{{height}} is beyond {{max}}",
    "texture.min_size": "{{width}}x{{height}} is below {{min}}",
    "texture.non_square": "{{width}}x{{height}} is not square",
    "texture.file_size": "File has {{size_mb}} MB; {{max_mb}} are allowed",
    "texture.no_mipmaps": "{{width}}x{{height}} without mipmaps",
    "texture.color_space": "Data texture ({{suffix}}) is stored as sRGB",
    "model.vertices": "{{count}} vertices; {{max}} are allowed",
    "model.faces": "{{count}} faces; {{max}} are allowed",
    "model.materials": "{{count}} materials; {{max}} are allowed",
    "audio.sample_rate": "Sample rate {{rate}} is not allowed",
    "audio.sfx_duration": "Sound effect of {{seconds}} s; {{max}} are allowed",
    "audio.stereo_sfx": "Sound effect with {{channels}} channels",
    "audio.file_size": "File has {{size_mb}} MB; {{max_mb}} are allowed",
    "duplicate": "{{count}} equal files",
    "missing_reference": "Refers to {{guid}}, which nothing holds",
    "pbr_set.incomplete": "Set {{set}} lacks {{missing}}",
    "dcc_source.outdated_export": "Export is {{age}} older than its source",
}


def issue(rule_id: str, severity: str, fixable: bool = False, **args: Column) -> Column:
    pairs = [x for k, v in args.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(fixable).alias("auto_fixable"), F.col("path").alias("asset_path"),
        F.array().cast("array<string>").alias("related_paths"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("args"),
    )


def _first(*cases: tuple[Column | None, Column]) -> Column:
    """The issue of the first condition that holds; null where none does."""
    out = None
    for when, found in cases:
        if when is not None:
            out = F.when(when, found) if out is None else out.when(when, found)
    return F.lit(None).cast(ISSUE) if out is None else out


def _m(name: str) -> Column:
    return F.col(f"metadata.{name}")


def _mb(n: Column) -> Column:
    return F.call_function("format_number", n / (1 << 20), F.lit("0.00"))


def required_prefix(c: Naming) -> Column:
    kinds = {"texture": c.texture_prefix, "model": c.model_prefix, "audio": c.audio_prefix}
    out = F.lit(None).cast("string")
    for kind, prefix in kinds.items():
        if prefix is not None:
            out = F.when(F.col("asset_type") == kind, F.lit(prefix)).otherwise(out)
    return out


def fits_case(name: Column, style: str) -> Column:
    """Whether a name (past its prefix) is in the style; unknown styles fit all, and so does ''."""
    patterns = {"PascalCase": r"(?s)^(\p{Lu}[^_]*)?$", "camelCase": r"(?s)^(\p{Ll}[^_]*)?$", "snake_case": r"^[\p{Ll}\p{N}_]*$", "kebab-case": r"^[\p{Ll}\p{N}-]*$"}
    return name.rlike(patterns[style]) if style in patterns else F.lit(True)


def forbidden_class(c: Naming) -> str:
    return "[" + "".join(re.escape(x) for x in c.forbidden_chars) + "]"


def past_prefix(stem: Column, prefix: Column) -> Column:
    return F.when(F.coalesce(stem.startswith(prefix), F.lit(False)), F.substring(stem, F.length(prefix) + 1, F.length(stem))).otherwise(stem)


def naming(c: Naming) -> Column:
    name, prefix = F.col("name"), required_prefix(c)
    bad = forbidden_class(c) if c.forbidden_chars else None
    return _first(
        (F.length(name) > c.max_length, issue("naming.length", "warning", length=F.length(name), max=F.lit(c.max_length))),
        (name.rlike(bad) if bad else None, issue("naming.forbidden_char", "warning", True, char=F.regexp_extract(name, f"({bad})", 1))),
        (text.has_cjk(name) if c.forbid_chinese else None, issue("naming.chinese", "warning")),
        (prefix.isNotNull() & ~name.startswith(prefix) & _m("dcc_source_kind").isNull(), issue("naming.prefix", "warning", True, prefix=prefix)),
        (~fits_case(past_prefix(text.stem(name), prefix), c.case_style), issue("naming.case", "info", True, style=F.lit(c.case_style))),
    )


def _next_power(x: Column) -> Column:
    return F.when(text.power_of_two(x), x).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(x, F.lit(1))))))


def texture(c: Texture) -> Column:
    w, h = _m("width"), _m("height")
    sides = {"width": w, "height": h}
    wrong = F.col("asset_type") == "texture"
    return F.when(wrong, _first(
        ((~text.power_of_two(w) | ~text.power_of_two(h)) if c.require_pot else None, issue("texture.pot", "warning", **sides, next_width=_next_power(w), next_height=_next_power(h))),
        ((w > c.max_size) | (h > c.max_size), issue("texture.max_size", "warning", **sides, max=F.lit(c.max_size))),
        ((w < c.min_size) | (h < c.min_size), issue("texture.min_size", "info", **sides, min=F.lit(c.min_size))),
        ((w != h) if c.warn_non_square else None, issue("texture.non_square", "info", **sides)),
        (F.col("size") > c.max_file_size, issue("texture.file_size", "warning", size_mb=_mb(F.col("size")), max_mb=_mb(F.lit(c.max_file_size)))),
        ((_m("mipmap_count") <= 1) & ((w >= 512) | (h >= 512)), issue("texture.no_mipmaps", "info", **sides)),
    ))


def color_space() -> Column:
    stem = F.lower(text.stem(F.col("name")))
    suffix = F.get(F.filter(F.array(*map(F.lit, DATA_SUFFIXES)), lambda s: stem.endswith(s)), F.lit(0))
    return F.when((F.col("asset_type") == "texture") & (_m("color_space") == "sRGB") & suffix.isNotNull(), issue("texture.color_space", "warning", suffix=suffix))


def model(c: Model) -> Column:
    over = lambda name, most: (_m(name) > most, {"count": _m(name), "max": F.lit(most)})
    cases = (("vertices", over("vertex_count", c.max_vertices)), ("faces", over("face_count", c.max_faces)), ("materials", over("material_count", c.max_materials)))
    return F.when(F.col("asset_type") == "model", _first(*((when, issue(f"model.{name}", "warning", **args)) for name, (when, args) in cases)))


def audio(c: Audio) -> Column:
    effect = F.arrays_overlap(text.sound_words(text.stem(F.col("name"))), F.array(*map(F.lit, SOUND_WORDS)))
    seconds = _m("duration_secs")
    return F.when((F.col("asset_type") == "audio") & F.col("metadata").isNotNull(), _first(
        ((~_m("sample_rate").isin(*c.allowed_sample_rates)) if c.allowed_sample_rates else None, issue("audio.sample_rate", "info", rate=_m("sample_rate"))),
        (effect & (seconds > c.max_sfx_duration), issue("audio.sfx_duration", "warning", seconds=F.call_function("format_number", seconds, F.lit("0.0")), max=F.lit(c.max_sfx_duration))),
        ((effect & (_m("channels") > 1)) if c.warn_stereo_sfx else None, issue("audio.stereo_sfx", "info", channels=_m("channels"))),
        (F.col("size") > c.max_file_size, issue("audio.file_size", "warning", size_mb=_mb(F.col("size")), max_mb=_mb(F.lit(c.max_file_size)))),
    ))


def families(c: RuleConfig) -> list[Column]:
    """The issue columns in order; any Column of the ISSUE type may be added by callers."""
    found = [naming(c.naming)] if c.naming.enabled else []
    found += [texture(c.texture)] if c.texture.enabled else []
    found += [color_space()] if c.texture.color_space else []
    found += [model(c.model)] if c.model.enabled else []
    return found + ([audio(c.audio)] if c.audio.enabled else [])


def asset_issues(assets: DataFrame, c: RuleConfig = RuleConfig(), extra: tuple[Column, ...] = ()) -> DataFrame:
    """The issues of single assets: rule_id, severity, auto_fixable, asset_path, related_paths, args."""
    found = [*families(c), *extra]
    if not found:
        return assets.select(F.lit(None).cast(ISSUE).alias("i")).where("false").select("i.*")
    return assets.select(F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.*")


def not_ignored(assets: DataFrame, patterns: tuple[str, ...], root: str) -> DataFrame:
    """The assets whose path below root no glob matches; a malformed glob raises ValueError."""
    if not patterns:
        return assets
    whole = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return assets.where(~text.relative_path(F.col("path"), root).rlike(whole))


def with_message(issues: DataFrame) -> DataFrame:
    templates = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))
    return issues.withColumn("message", text.render(templates[F.col("rule_id")], F.col("args")))


def fix_name(c: Naming) -> Column:
    """A name without the one naming issue that naming(c) reports, or null where no safe one is known."""
    name, stem, ext, prefix = F.col("name"), text.stem(F.col("name")), text.dotted_extension(F.col("name")), required_prefix(c)
    bad = forbidden_class(c) if c.forbidden_chars else "(?!)"
    sep = "" if {"_", "-"} <= set(c.forbidden_chars) else "-" if "_" in c.forbidden_chars else "_"
    clean = F.regexp_replace(stem, bad, sep)
    if sep:
        clean = F.regexp_replace(F.regexp_replace(clean, f"{sep}+", sep), f"^{sep}|{sep}$", "")
    cleaned = F.concat(clean, ext)
    tail = past_prefix(stem, prefix)
    words = text.case_words(tail)
    proper = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    styled = {
        "snake_case": F.array_join(F.transform(words, F.lower), "_"),
        "kebab-case": F.array_join(F.transform(words, F.lower), "-"),
        "PascalCase": F.array_join(F.transform(words, proper), ""),
        "camelCase": F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(proper(w))), ""),
    }.get(c.case_style, F.lit(None).cast("string"))
    restyled = F.concat(F.substring(stem, 1, F.length(stem) - F.length(tail)), styled, ext)
    long = lambda x: F.length(x) > c.max_length
    return (
        F.when(long(name), F.lit(None))
        .when(name.rlike(bad), F.when((clean != "") & (cleaned != name) & ~cleaned.rlike(bad), cleaned))
        .when(text.has_cjk(name) & F.lit(c.forbid_chinese), F.lit(None))
        .when(prefix.isNotNull() & ~name.startswith(prefix) & _m("dcc_source_kind").isNull(), F.when((prefix != "") & ~long(F.concat(prefix, name)), F.concat(prefix, name)))
        .when(~fits_case(tail, c.case_style), F.when((styled != "") & (restyled != name) & fits_case(past_prefix(text.stem(restyled), prefix), c.case_style) & ~long(restyled), restyled))
    )


def with_collisions(names: DataFrame) -> DataFrame:
    """names (path, new_name) and collides: another row of the directory asks for that name, case ignored."""
    key = [F.lower(text.parent(F.col("path"))).alias("_d"), F.lower("new_name").alias("_n")]
    counts = names.where("new_name IS NOT NULL").groupBy(*key).agg(F.count("*").alias("_c"))
    joined = names.withColumns({"_kd": F.lower(text.parent(F.col("path"))), "_kn": F.lower("new_name")}).join(counts, (F.col("_kd") == F.col("_d")) & (F.col("_kn") == F.col("_n")), "left")
    return joined.withColumn("collides", F.coalesce(F.col("_c") > 1, F.lit(False))).drop("_kd", "_kn", "_d", "_n", "_c")


def checked_again(names: DataFrame, included: str = "included") -> DataFrame:
    """names after edits (path, new_name, included) and collides, counted over the included rows only."""
    marked = with_collisions(names.withColumn("_asked", F.col("new_name")).withColumn("new_name", F.when(F.col(included), F.col("new_name"))))
    return marked.withColumn("new_name", F.col("_asked")).drop("_asked")


def renamed(name: Column, operation: str, value: str = "", other: str = "") -> Column:
    """The name after a batch operation; find and replace is literal, and no change for an empty find."""
    stem, ext = text.stem(name), text.dotted_extension(name)
    n = len(value)
    if operation == "find_replace":
        return F.replace(name, F.lit(value), F.lit(other)) if value else name
    if operation == "add_prefix":
        return F.concat(F.lit(value), name)
    if operation == "add_suffix":
        return F.concat(stem, F.lit(value), ext)
    if operation == "remove_prefix":
        return F.when(name.startswith(value), F.substring(name, n + 1, 1 << 30)).otherwise(name)
    if operation == "remove_suffix":
        return F.concat(F.when(stem.endswith(value), F.substring(stem, F.lit(1), F.length(stem) - n)).otherwise(stem), ext)
    if operation in ("lowercase", "uppercase"):
        return F.lower(name) if operation == "lowercase" else F.upper(name)
    if operation == "title_case":
        return F.array_join(F.transform(F.split(name, "[_ -]", -1), text.capitalised), "_")
    raise ValueError(f"unknown operation {operation!r}")
