"""Tags: bindings, suggestions from names, sizes and folders, learned rules, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.catalog import order_key
from ..sources.storage import stored

# Words and folders that name no kind, endings of texture channels, colours.
WORD_STOPS = "tex texture model asset assets img image obj fbx png jpg jpeg tga wav mp3 ogg default new old copy tmp temp test draft final low high lod lod0 lod1 lod2".split()
FOLDER_STOPS = "assets content src source sources resources data files project projects import imports".split()
CHANNEL_ROLES = {
    "basecolor": "BaseColor", "albedo": "BaseColor", "diffuse": "BaseColor", "color": "BaseColor", "normal": "Normal", "norm": "Normal", "roughness": "Roughness", "rough": "Roughness",
    "metallic": "Metallic", "metal": "Metallic", "ao": "AO", "ambientocclusion": "AO", "emissive": "Emissive", "emission": "Emissive", "height": "Height", "disp": "Height", "orm": "ORM", "mra": "MRA", "rma": "RMA",
}
PALETTE = ["#d4924a", "#5fb8a0", "#b588d0", "#5fa6cf", "#c9a558", "#8088c4", "#c87aa8", "#6589c7"]
MOST_GROUPS, SAMPLES, FEW_ASSETS, MERGE_ABOVE = 12, 3, 30, 0.8


# --- bindings -----------------------------------------------------------------------------


def bind(bindings: DataFrame, new: DataFrame, tags: DataFrame) -> DataFrame:
    """bindings (path, tag_id) with new ones of known tags; binding twice changes nothing."""
    return bindings.unionByName(new.join(tags.select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select("path", "tag_id")).distinct()


def unbind(bindings: DataFrame, gone: DataFrame) -> DataFrame:
    return bindings.join(gone, ["path", "tag_id"], "left_anti")


def put_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """tags (id, name, description) with the rows of new in place of those with the same id; a blank description is none."""
    description = F.when(F.trim("description") != "", F.col("description"))
    return tags.join(new.select("id"), "id", "left_anti").unionByName(new.select("id", "name", description.alias("description")))


def drop_tags(tags: DataFrame, bindings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tags and bindings without the given tag ids."""
    return tags.join(ids, "id", "left_anti"), bindings.join(ids.withColumnRenamed("id", "tag_id"), "tag_id", "left_anti")


def move_bindings(bindings: DataFrame, old: str, new: str) -> DataFrame:
    """Bindings after a file or folder moved; what the target already had stays, once."""
    hit = (F.col("path") == old) | F.col("path").startswith(old + "/")
    return bindings.withColumn("path", F.when(hit, F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))).otherwise(F.col("path"))).distinct()


def tags_of(bindings: DataFrame, tags: DataFrame) -> DataFrame:
    """path with the sorted names of its tags; ids of no tag are left out."""
    return bindings.join(tags, F.col("tag_id") == F.col("id")).groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("tags"))


def assets_of(bindings: DataFrame, tags: DataFrame) -> DataFrame:
    """tag and path of every binding of a known tag, a row each; order by tag and path to list them."""
    return bindings.join(tags, F.col("tag_id") == F.col("id")).select(F.col("name").alias("tag"), "path").distinct()


def new_labels(proposed: DataFrame, tags: DataFrame) -> DataFrame:
    """Proposed labels that no tag has, case ignored."""
    return proposed.join(tags.select(F.lower("name").alias("_n")), F.lower("label") == F.col("_n"), "left_anti").select("label").distinct()


# --- suggestions --------------------------------------------------------------------------


def _useful_words() -> Column:
    words = F.array_distinct(text.tag_words(text.stem(F.col("name"))))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\p{N}+$") & ~w.rlike(r"^v[0-9]{1,3}$") & ~w.isin(*WORD_STOPS))


def _side_class() -> Column:
    """Null but for textures with a side of 256 or more."""
    roles = F.create_map(*(F.lit(x) for kv in CHANNEL_ROLES.items() for x in kv))
    role = roles[F.lower(F.regexp_extract(text.stem(F.col("name")), "_([^_]*)$", 1))]
    named = lambda side: F.concat(text.floor_power_of_two(side).cast("string"), F.coalesce(F.concat(F.lit(" "), role), F.lit("")))
    longest = F.when(F.col("asset_type") == "texture", F.greatest("metadata.width", "metadata.height"))
    # the side is computed once, however often it is used
    return F.get(F.transform(F.array(longest), lambda side: F.when(side >= 256, named(side))), F.lit(0))


def _useful_folders(root: str) -> Column:
    parts = F.split("dir", "/", -1)
    inner = F.array_distinct(F.slice(parts, F.lit(len(root.rstrip("/").split("/")) + 1), F.greatest(F.size(parts), F.lit(1))))
    return F.filter(inner, lambda s: (s != "") & ~F.lower(s).isin(*FOLDER_STOPS))


def name_tokens(assets: DataFrame) -> DataFrame:
    """path and token: the useful words of each name, once."""
    return assets.select("path", F.explode(_useful_words()).alias("token"))


def side_classes(assets: DataFrame) -> DataFrame:
    """path and token (2048, or `2048 Normal` beside it) of the textures with a side of 256 or more."""
    return assets.select("path", _side_class().alias("token")).where("token IS NOT NULL")


def folder_tokens(assets: DataFrame, root: str) -> DataFrame:
    """path and token: each directory below root that says something, once."""
    return assets.select("path", F.explode(_useful_folders(root)).alias("token"))


def token_counts(tokens: DataFrame, least: int) -> DataFrame:
    return tokens.groupBy("token").agg(F.count_distinct("path").alias("n")).where(F.col("n") >= least)


HINTS = ("filename", "dimension", "folder")


def raw_groups(assets: DataFrame, root: str) -> DataFrame:
    """name and path of every group that has enough files in one of the three passes, with its hint.

    Rows are memberships, not lists: (name, hint, path), once each. The first pass that finds
    a name gives its hint. Small catalogs have lower limits. The catalog is read once: its
    tokens of all passes are written down, counted together and joined with their counts.
    """
    few = assets.limit(FEW_ASSETS).count() < FEW_ASSETS
    least = F.when(F.col("pass") == 1, 3 if few else 5).otherwise(2 if few else 3)
    plain = assets.select("path", "name", "dir", "asset_type", F.struct(F.col("metadata.width").alias("width"), F.col("metadata.height").alias("height")).alias("metadata"))
    tagged = lambda tokens, n: F.transform(tokens, lambda t: F.struct(F.lit(n).alias("pass"), t.alias("token")))
    sides = F.array_compact(F.array(_side_class()))
    # written down before it is cut: the columns of a view are long expressions, which every use would repeat
    plain = stored(plain, "catalog")
    rows = plain.select("path", F.explode(F.concat(tagged(_useful_words(), 0), tagged(sides, 1), tagged(_useful_folders(root), 2))).alias("t")).select("path", "t.pass", "t.token")
    rows = stored(rows.distinct(), "tokens")
    kept = rows.groupBy("pass", "token").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("name", text.capitalised(F.col("token")))
    first = kept.groupBy("name").agg(F.min("pass").alias("first"))
    named = stored(kept.select("pass", "token", "name").join(first, "name").select("pass", "token", "name", F.get(F.array(*map(F.lit, HINTS)), F.col("first")).alias("hint")), "names")
    return rows.join(named, ["pass", "token"]).select("name", "path", "hint").distinct()


def samples(groups: DataFrame, k: int = SAMPLES) -> DataFrame:
    """name and its first k paths in order; a top-k by group, which Spark cuts down before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    return groups.select("name", "path").withColumn("r", rank).where(F.col("r") <= k).groupBy("name").agg(F.array_sort(F.collect_list("path")).alias("samples"))


def group_sizes(groups: DataFrame, total: int) -> DataFrame:
    """name, hint, n, confidence (share of the catalog, as float), first path."""
    sized = groups.groupBy("name", "hint").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    return sized.withColumn("confidence", F.least(F.col("n") / F.lit(max(total, 1)), F.lit(1.0)).cast("float"))


def merged_groups(assets: DataFrame, root: str) -> DataFrame:
    """Groups after near-equal ones are folded: name, hint, n, confidence, colour, samples; 12 at most.

    Groups are taken by size and name. One is folded into the first earlier one of which one
    name begins the other's, both sizes are near (over 0.8) and the files overlap by more
    than 0.8 (Jaccard); what is kept grows. Memberships stay in Spark: names that begin each
    other meet through their prefixes, and each round decides the next group of every chain of
    such names by the sizes of intersections, then rewrites the memberships. The driver sees
    names and counts of groups that may fold.
    """
    total = assets.count()
    groups = stored(raw_groups(assets, root), "groups")
    sizes = stored(group_sizes(groups, total), "sizes")
    low = F.lower("name")
    prefixes = sizes.select(F.col("name").alias("longer"), F.col("n").alias("m"), F.explode(F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(low, F.lit(1), i))).alias("low"))
    near = prefixes.join(sizes.select(F.col("name").alias("shorter"), "n", low.alias("low")), "low").where("longer <> shorter").select("shorter", "longer", "n", "m").distinct()
    # the earlier group is the larger one and only grows: sizes that are not near now never are
    chains = Chains([(r["shorter"], r["longer"], r["n"], r["m"]) for r in near.where(F.least("n", "m") > MERGE_ABOVE * F.greatest("n", "m")).toLocalIterator()])
    members = groups.select("name", "path")
    if chains.names:
        known = assets.sparkSession.createDataFrame([(x,) for x in chains.names], "name string")
        held = stored(members.join(known, "name", "left_semi"), "held")
        while pairs := chains.asked():
            asked = assets.sparkSession.createDataFrame(pairs, "name string, other string")
            both = held.join(asked, "name").join(held.select(F.col("name").alias("other"), "path"), ["other", "path"]).groupBy("name", "other").agg(F.count("*").alias("n"))
            folded = chains.decide({(r["name"], r["other"]): r["n"] for r in both.collect()})
            if folded:
                into = assets.sparkSession.createDataFrame(folded, "name string, into string")
                held = stored(held.join(into, "name", "left").select(F.coalesce("into", "name").alias("name"), "path").distinct(), "held")
        members = members.join(known, "name", "left_anti").unionByName(held)
    grown = members.groupBy("name").agg(F.count("*").alias("n")).join(sizes.select("name", "hint"), "name")
    best = grown.withColumn("confidence", F.least(F.col("n") / F.lit(max(total, 1)), F.lit(1.0)).cast("float")).orderBy(F.desc("confidence"), F.desc("n"), "name").limit(MOST_GROUPS)
    best = stored(best, "best")
    shown = best.join(samples(members.join(best.select("name"), "name", "left_semi")), "name")
    return shown.select("name", "hint", "n", "confidence", text.stable_colour(F.col("name"), PALETTE).alias("color"), F.col("samples")[0].alias("first_path"), "samples")


class Chains:
    """Names of groups that may fold, with their sizes: in every chain the largest undecided one is next."""

    def __init__(self, pairs: list[tuple[str, str, int, int]]):
        self.size: dict[str, int] = {}
        self.links: dict[str, set[str]] = {}
        for a, b, n, m in pairs:
            self.size |= {a: n, b: m}
            self.links.setdefault(a, set()).add(b)
            self.links.setdefault(b, set()).add(a)
        self.names = sorted(self.size, key=lambda x: (-self.size[x], x))
        self.first_size, self.place = dict(self.size), {x: i for i, x in enumerate(self.names)}
        self.open = set(self.names)
        self.kept: set[str] = set()

    def _next(self) -> list[str]:
        """Undecided names that no undecided earlier one is linked with."""
        return [x for x in self.names if x in self.open and not any(y in self.open and self.place[y] < self.place[x] for y in self.links[x])]

    def asked(self) -> list[tuple[str, str]]:
        """The pairs whose intersections decide the next names; those without one are kept at once."""
        while self.open:
            self.now = {x: [k for k in sorted(self.links[x] & self.kept, key=self.place.get) if min(self.size[x], self.size[k]) > MERGE_ABOVE * max(self.size[x], self.size[k])] for x in self._next()}
            if pairs := [(x, k) for x, many in self.now.items() for k in many]:
                return pairs
            self.decide({})
        return []

    def decide(self, both: dict[tuple[str, str], int]) -> list[tuple[str, str]]:
        """Folds (name, into) by the sizes of intersections; a kept name that several would join takes one a round."""
        out, taken = [], set()
        for x in sorted(self.now, key=self.place.get):
            many = self.now[x]
            if taken & set(many):
                continue  # what it would join has grown: asked again
            n = self.size[x]
            into = next((k for k in many if (c := both.get((x, k), 0)) > MERGE_ABOVE * (n + self.size[k] - c)), None)
            self.open.discard(x)
            if into is None:
                self.kept.add(x)
            else:
                out.append((x, into))
                taken.add(into)
                self.size[into] += n - both[x, into]
        return out


def unsuggested(groups: DataFrame, tags: DataFrame) -> DataFrame:
    """groups whose suggested tag (`<name> (suggested)`) no tag is yet."""
    return groups.join(tags.select(F.col("name").alias("tag_name")), F.concat("name", F.lit(" (suggested)")) == F.col("tag_name"), "left_anti")


def learned_matches(assets: DataFrame, rules: DataFrame, root: str) -> DataFrame:
    """path, tag, confidence, ord of the learned rules (ord, kind, pattern, tags, confidence) that fit.

    token: anywhere in the name, case ignored; prefix: of the path below root; segment: a
    directory or the name, case ignored; regex: anywhere in the path below root. Rules are few
    and written by hand; their number is checked before they are sent to every task.
    """
    if rules.count() > 10_000:
        raise ValueError("over 10000 rules")
    rel = text.relative_path(F.col("path"), root)
    rows = assets.select("path", F.lower("name").alias("low"), rel.alias("rel"), F.split(F.lower(rel), "/", -1).alias("parts"))
    fits = F.when(F.col("kind") == "token", F.col("low").contains(F.lower("pattern"))).when(F.col("kind") == "prefix", F.col("rel").startswith(F.col("pattern"))).when(F.col("kind") == "segment", F.array_contains("parts", F.lower("pattern"))).when(F.col("kind") == "regex", F.rlike("rel", F.col("pattern"))).otherwise(F.lit(False))
    return rows.join(F.broadcast(rules), fits).select("path", F.explode("tags").alias("tag"), "confidence", "ord")


def learned_groups(matches: DataFrame, k: int = 24) -> DataFrame:
    """tag, n files, best confidence and the rule that first gave it; the k best."""
    best = F.struct(-F.col("confidence"), order_key(), F.col("ord"))
    out = matches.groupBy("tag").agg(F.count_distinct("path").alias("n"), F.max("confidence").alias("confidence"), F.min_by("ord", best).alias("rule"))
    return out.orderBy(F.desc("confidence"), F.desc("n"), "tag").limit(k)


def learned_samples(matches: DataFrame, k: int = SAMPLES) -> DataFrame:
    """tag and the stems of its first k files in order of the catalog."""
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.lower("path"), "path"))
    first = matches.select("tag", "path").distinct().withColumn("r", rank).where(F.col("r") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("r", text.stem(text.base_name(F.col("path"))).alias("stem"))))
    return first.groupBy("tag").agg(F.transform(ordered, lambda x: x["stem"]).alias("samples"))


def suggestions(assets: DataFrame, root: str, rules: DataFrame | None) -> tuple[str, DataFrame]:
    """Which way suggestions are made (learned or heuristic), and the groups: name, n, confidence.

    Learned rules are taken if there are any; without (no file, none in it, or a file that
    can't be read, see plans.files.learned_rules) the names, sizes and folders speak.
    """
    if rules is not None and not rules.isEmpty():
        return "learned", learned_groups(learned_matches(assets, rules, root)).select(F.col("tag").alias("name"), "n", F.col("confidence").cast("float").alias("confidence"))
    return "heuristic", merged_groups(assets, root).select("name", "n", "confidence")


# --- samples ------------------------------------------------------------------------------


def stratified_sample(assets: DataFrame, depth: int, rank: Column | None = None) -> DataFrame:
    """At most `depth` (3 to 30) files of each directory, types in turn: dir, asset_type, path, rn.

    The n-th file of every type comes before the n+1-st of any. rank orders the files of a
    type; by default a hash of the path. Top-k per (directory, type) first, so that a directory
    with a third of all files is cut down in parallel and before it is gathered.
    """
    depth = min(max(depth, 3), 30)
    rank = F.xxhash64(F.lit(0), "path") if rank is None else rank
    rows = assets.select("dir", "asset_type", "path", rank.alias("_rank"), F.pmod(F.xxhash64("path"), F.lit(64)).alias("_salt"))
    parts = Window.partitionBy("dir", "asset_type", "_salt").orderBy("_rank", "path")
    few = rows.withColumn("_n", F.row_number().over(parts)).where(F.col("_n") <= depth)
    each = Window.partitionBy("dir", "asset_type").orderBy("_rank", "path")
    turn = few.withColumn("rn", F.row_number().over(each)).where(F.col("rn") <= depth)
    whole = Window.partitionBy("dir").orderBy("rn", "asset_type")
    return turn.withColumn("_p", F.row_number().over(whole)).where(F.col("_p") <= depth).select("dir", "asset_type", "path", F.col("rn").cast("long").alias("rn"))
