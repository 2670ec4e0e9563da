"""Site identities: merging registries, matching by key, spelling and place, collapsing duplicates, and sourced facts.

Where several candidates fit, an operator refuses; it never picks one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sitecast.functions import text as T
from sitecast.functions.columns import M_PER_DEG as M, flat_distance_m
from sitecast.operators.geo import near_pairs
from sitecast.sources.scratch import drop, kept


def load_union(sources: Sequence[DataFrame]) -> DataFrame:
    """Sources in their order, rows without a name or key dropped; ``src_ord`` says where each came from."""
    out = None
    for i, df in enumerate(sources):
        rows = df.where("name is not null and trim(name) <> '' and key is not null and key <> ''").withColumn("src_ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def merge(rows: DataFrame, fields: Sequence[str], order: str = "src_ord") -> DataFrame:
    """One record a key, or one for each place where a key has several (then rows without a place are dropped).

    Every field comes from the first source that has it, the name is the longest (the first of equal length).
    """
    placed = rows.withColumn("_place", F.lower(F.trim(F.coalesce("place", F.lit("")))))
    many = placed.where("_place <> ''").groupBy("key").agg(F.count_distinct("_place").alias("_n"))
    held = placed.join(many, "key", "left").withColumn("_g", F.when(F.col("_n") > 1, F.col("_place")).otherwise(""))
    held = held.where("_n is null or _n <= 1 or _place <> ''")
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col(c)), F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col(order))).alias(c)
    name = F.max_by("name", F.struct(F.length("name"), -F.col(order))).alias("name")
    return held.groupBy("key", "_g").agg(name, *(first(c) for c in fields), F.count("*").alias("n_records")).drop("_g")


def match_exact(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Queries (query_id, key) with their only entry of equal key; none where it is missing or ambiguous."""
    return _only(queries, registry.groupBy("key").agg(F.count("*").alias("hits"), F.min("entry_id").alias("entry_id")))


def _only(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Queries with the ``found`` (key, hits, entry_id) of their key, the entry where it is the only one."""
    return queries.select("query_id", "key").join(found, "key", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("entry_id")).alias("entry_id"))


def tokens(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda t: F.length(t) >= 3)


def tokens_match(a: Column, b: Column) -> Column:
    """Equal, or a shared prefix of four characters at least and of 0.7 of the longer."""
    k = F.greatest(F.lit(4), F.floor((7 * F.greatest(F.length(a), F.length(b)) + 9) / 10).cast("int"))
    return (a == b) | ((F.length(a) >= k) & (F.length(b) >= k) & (F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k)))


def match_fuzzy(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Queries with their only entry whose tokens hold the query's head and all its others.

    Each of a query's tokens must match, so candidates meet on one of them alone: the one that the fewest spellings
    answer.  Matching tokens are equal or share the first four letters and 0.7 of each, so a token meets those that begin
    with that much of it: nothing is missed.  Distinct keys meet, not rows: tokens that many entries share are
    compared once for each spelling, and only then are the entries counted.
    """
    asked = queries.select(F.col("key").alias("asked")).distinct()
    entries = kept(registry.where(F.col("key").isNotNull()).select("key", "entry_id").distinct(), "entries")
    has = lambda t: F.exists("k", lambda o: tokens_match(t, o))
    met = fuzzy_candidates(asked, entries.select("key").distinct()).withColumns({"q": tokens(F.col("asked")), "k": tokens(F.col("key"))}).where(F.forall("q", has)).select("asked", "key")
    found = met.join(entries, "key").select("asked", "entry_id").distinct()
    return _only(queries, found.groupBy(F.col("asked").alias("key")).agg(F.count("*").alias("hits"), F.min("entry_id").alias("entry_id")))


def fuzzy_candidates(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs (asked, key) of distinct ``asked`` and ``key`` that meet on the token of asked which the fewest keys answer."""
    # What a token must begin with, and all that a listed one begins with; tokens of three letters only as a whole.
    start = F.transform(F.array_distinct(tokens(F.col("asked"))), lambda t: F.left(t, F.greatest(F.lit(4), F.ceil(F.length(t) * 7 / F.lit(10) - 1e-9).cast("int"))))
    starts = F.array_distinct(F.flatten(F.transform(tokens(F.col("key")), lambda t: F.transform(F.sequence(F.least(F.lit(4), F.length(t)), F.length(t)), lambda n: F.left(t, n)))))
    wanted = kept(asked.select("asked", F.explode(start).alias("b")), "asked")
    answers = kept(listed.select("key", F.explode(starts).alias("b")).join(wanted.select("b").distinct(), "b", "left_semi"), "answers")
    many = answers.groupBy("b").agg(F.count("*").alias("many"))
    fewest = wanted.join(many, "b", "left").groupBy("asked").agg(F.min_by("b", F.struct(F.coalesce("many", F.lit(0)), "b")).alias("b"))
    return fewest.join(answers, "b").select("asked", "key")


def cascade(queries: DataFrame, inside: DataFrame, exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Position, then equal key, then spelling; several equal keys end it without a match."""
    rows = queries.select("query_id").join(inside.select("query_id", F.col("entry_id").alias("p")), "query_id", "left").join(exact.select("query_id", F.col("entry_id").alias("e"), F.col("hits").alias("eh")), "query_id", "left").join(fuzzy.select("query_id", F.col("entry_id").alias("f")), "query_id", "left")
    open_ = F.coalesce(F.col("eh"), F.lit(0)) == 0
    how = F.when(F.col("p").isNotNull(), "inside").when(F.col("e").isNotNull(), "exact").when(open_ & F.col("f").isNotNull(), "fuzzy")
    return rows.select("query_id", how.alias("how"), F.when(how == "inside", F.col("p")).when(how == "exact", F.col("e")).when(how == "fuzzy", F.col("f")).alias("entry_id"))


def find_existing(candidates: DataFrame, sites: DataFrame, metres: float = 600.0) -> DataFrame:
    """The stored site of each candidate: same map object first, else the same name (either spelling) within reach, the nearest."""
    by_id = candidates.join(sites.select("osm_type", "osm_id", F.col("site_id").alias("by_id")), ["osm_type", "osm_id"]).groupBy("cand_id").agg(F.min("by_id").alias("by_id"))
    # Names and places meet, not rows: what is equal in both has one answer, the smallest id.
    names = sites.select("site_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"), F.explode(F.array_distinct(F.filter(F.array(F.lower("name"), F.lower("name_alt")), lambda x: x.isNotNull()))).alias("n")).groupBy("n", "slat", "slon").agg(F.min("site_id").alias("site_id"))
    named = candidates.select("cand_id", F.lower("name").alias("n"), "lat", "lon")
    near = near_pairs(named.select("n", "lat", "lon").distinct(), names, metres / 1000, "slat", "slon", ("n",)).withColumn("d", flat_distance_m(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))).where(F.col("d") <= metres)
    nearest = near.groupBy("n", "lat", "lon").agg(F.min(F.struct("d", "site_id")).alias("best"))
    by_name = named.join(nearest, ["n", "lat", "lon"]).groupBy("cand_id").agg(F.min("best")["site_id"].alias("by_name"))
    return candidates.select("cand_id").join(by_id, "cand_id", "left").join(by_name, "cand_id", "left").select("cand_id", F.coalesce("by_id", "by_name").alias("site_id"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").alias("how"))


def newest_for_keys(sites: DataFrame, reports: DataFrame) -> DataFrame:
    """The newest season's record under any of a site's keys; within a season ambiguity is refused."""
    met = sites.select("site_id", F.explode(F.array_distinct("keys")).alias("key")).join(reports, "key")
    seasons = met.groupBy("site_id", "year").agg(F.count("*").alias("n"), F.min("kg_per_angler_day").alias("rate")).where("n = 1")
    return seasons.groupBy("site_id").agg(F.max("year").alias("year"), F.max_by("rate", "year").alias("rate"))


def back_fill(sites: DataFrame, matches: DataFrame) -> DataFrame:
    """Null type and key filled from the match, the registry's name kept beside the old one; what changed is listed."""
    rows = sites.join(matches, "site_id", "left")
    renamed = F.col("m_name").isNotNull() & (F.col("m_name") != F.col("name"))
    changes = F.filter(F.array(F.when(F.col("water_type").isNull() & F.col("m_type").isNotNull(), "type"), F.when(F.col("registry_key").isNull() & F.col("m_key").isNotNull(), "key"), F.when(renamed, "name")), lambda x: x.isNotNull())
    return rows.select("site_id", F.coalesce("m_name", "name").alias("name"), F.when(renamed, F.col("name")).alias("name_alt"), F.coalesce("water_type", "m_type").alias("water_type"), F.coalesce("registry_key", "m_key").alias("registry_key"), F.array_join(changes, ",").alias("changes"), F.col("m_key").isNull().alias("unresolved"))


def shared_keys(registry: DataFrame) -> DataFrame:
    return registry.groupBy("key").agg(F.count("*").alias("waters")).where("waters > 1")


def top_species(reports: DataFrame, names: dict[str, str], k: int = 1) -> DataFrame:
    """The ``k`` species with the largest share of each report's map, by name; ties in the order of their keys."""
    ranked = F.slice(F.array_sort(F.transform(F.map_entries("species_pct"), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("species")))), 1, k)
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return reports.select("*", F.posexplode(ranked).alias("place", "r")).withColumn("species", F.coalesce(F.try_element_at(label, F.col("r.species")), F.col("r.species"))).withColumn("share", -F.col("r.s")).drop("r", "species_pct")


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an order; ``dropDuplicates`` would take any."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def unique_slugs(rows: DataFrame, order: str) -> DataFrame:
    """Base slug, then -2, -3 in order."""
    place = F.row_number().over(Window.partitionBy("base").orderBy(order))
    return rows.withColumn("base", T.slug(F.col("name"))).withColumn("_p", place).withColumn("slug", F.when(F.col("_p") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("_p")))).drop("_p")


def _tiled(rows: DataFrame, metres: float) -> DataFrame:
    """``rows`` (key, lat, lon) with their tile (ty, tx): bands of that height, tiles as wide as it takes at the band's edge nearest to a pole."""
    band = F.floor(F.col("lat") * M / metres)
    return rows.withColumn("ty", band).withColumn("tx", F.floor(F.col("lon") / _tile_degrees(F.col("ty"), metres)))


def _tile_degrees(ty: Column, metres: float) -> Column:
    """Width of a band's tiles: nothing in it or in the bands beside it is further than one tile where it is within ``metres``."""
    far = F.radians(F.least(F.lit(90.0), (F.greatest(F.abs(ty), F.abs(ty + 1)) + 1) * metres / M))
    return metres / M / F.greatest(F.lit(0.01), F.cos(far))


def _wide(ty: int, metres: float) -> float:
    """The same for one band, inside a task."""
    far = math.radians(min(90.0, (max(abs(ty), abs(ty + 1)) + 1) * metres / M))
    return metres / M / max(0.01, math.cos(far))


def _touching(tiled: DataFrame, metres: float) -> DataFrame:
    """Edges (u, v), u above v, between the tiles of one key that hold points which may be within ``metres``."""
    tile = F.xxhash64("key", "ty", "tx")
    own = tiled.select("key", "ty", "tx", tile.alias("u")).distinct()
    width = _tile_degrees(F.col("ty"), metres)
    near = own.select("key", "u", (F.col("tx") * width).alias("lo"), ((F.col("tx") + 1) * width).alias("hi"), F.explode(F.sequence(F.col("ty") - 1, F.col("ty") + 1)).alias("ty"))
    beside = _tile_degrees(F.col("ty"), metres)
    near = near.withColumn("tx", F.explode(F.sequence(F.floor(F.col("lo") / beside) - 1, F.floor(F.col("hi") / beside) + 1))).drop("lo", "hi")
    met = near.join(own.withColumnRenamed("u", "v"), ["key", "ty", "tx"]).where("u <> v")
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): the smallest node that is reached.

    Every round each root hangs on its smallest neighbour and chains are halved until they end; what then still joins
    different roots are the next round's edges, so these shrink by half at least.
    """
    tree = kept(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    left = kept(edges, "joins")
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = kept(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")), "hooks")
        while True:
            above = up.select(F.col("u").alias("v"), F.col("v").alias("w"))
            nxt = kept(up.join(above, "v").select("u", F.col("w").alias("v"), (F.col("v") != F.col("w")).alias("moved")), "hooks")
            drop(up)
            up = nxt.select("u", "v")
            if not nxt.where("moved").limit(1).count():
                break
        grown = kept(tree.join(up.select(F.col("u").alias("root"), F.col("v").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        name = lambda c, up=up: up.select(F.col("u").alias(c), F.col("v").alias(f"{c}_root"))
        rest = left.join(name("u"), "u").join(name("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).where("u <> v")
        rest = kept(rest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "joins")
        for x in (tree, left, up):
            drop(x)
        tree, left = grown, rest
    return tree


def collapse(rows: DataFrame, metres: float = 1500.0) -> DataFrame:
    """One row for each water: equal key and both lines, or equal key and both areas near the group's first in order.

    Areas are led greedily by the first of their group, so the order matters.  What lies in tiles that don't
    touch can't decide on each other: the objects of one name fall into patches of touching tiles, each led on its own, in
    one pass that looks for leaders in the tiles around.  Of a group stays the relation, else the way, then
    the largest.
    """
    keyed = rows.withColumn("key", T.name_key(F.col("name"))).withColumn("linear", F.col("kind").isin(*T.LINEAR_TYPES))
    rank = F.when(F.col("osm_type") == "relation", 2).when(F.col("osm_type") == "way", 1).otherwise(0)
    keyed = keyed.withColumn("_rank", rank).withColumn("_area", F.coalesce("area_ha", F.lit(0.0)))
    best = F.max_by("cand_id", F.struct("_rank", "_area", -F.col("pos"))).alias("cand_id")
    lines = keyed.where("linear").groupBy("key").agg(best, F.count("*").alias("members"))

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        held: dict[tuple, list[tuple[int, float, float]]] = {}
        of = []
        for key, lat, lon in zip(group["key"], group["lat"], group["lon"], strict=True):
            near = []
            if not (math.isnan(lat) or math.isnan(lon)):  # without a place: a group of its own
                ty = math.floor(lat * M / metres)
                tile = {y: (key, y, math.floor(lon / _wide(y, metres))) for y in (ty - 1, ty, ty + 1)}
                around = [x for k, y, c in tile.values() for d in (-1, 0, 1) for x in held.get((k, y, c + d), ())]
                near = [i for i, a, b in around if math.hypot((lat - a) * M, (lon - b) * M * math.cos(math.radians((lat + a) / 2))) <= metres]
                if not near:
                    held.setdefault(tile[ty], []).append((len(of), lat, lon))
            of.append(min(near, default=len(of)))
        return group[["key", "cand_id", "pos", "_rank", "_area"]].assign(part=of)

    areas = kept(_tiled(keyed.where("not linear").select("key", "cand_id", "pos", "_rank", "_area", "lat", "lon"), metres).withColumn("tile", F.xxhash64("key", "ty", "tx")), "areas")
    patches = roots(_touching(areas, metres))
    # A task leads some thousand objects at once: whole patches, which can't decide on each other.
    some = F.pmod(F.xxhash64(F.coalesce("root", "tile")), F.lit(1 + areas.count() // 5_000))
    dealt = areas.join(patches.withColumnRenamed("node", "tile"), "tile", "left").withColumn("some", some)
    led = dealt.select("some", "key", "cand_id", "pos", "_rank", "_area", "lat", "lon").groupBy("some").applyInPandas(lambda g: lead(g).assign(some=g["some"].iloc[0]), "some long, key string, cand_id long, pos long, _rank int, _area double, part long")
    return lines.unionByName(led.groupBy("some", "key", "part").agg(best, F.count("*").alias("members")).drop("some", "part"))


def common_at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest common subsequence of each pair of strings, all pairs at once, a bit for each letter of ``a``.

    No matching of blocks has more letters.  Letters that keys don't use count as one, and strings of more than 64 letters as
    their length, which only raises the bound.
    """
    most = np.minimum([len(x) for x in a], [len(x) for x in b]).astype(np.int64)
    short = np.flatnonzero(np.fromiter((len(x) <= 64 for x in a), bool, len(a)))
    if not len(short):
        return most
    codes = {c: i for i, c in enumerate(" 0123456789abcdefghijklmnopqrstuvwxyz")}
    one = np.uint64(1)
    masks = np.zeros((len(short), len(codes) + 1), np.uint64)
    for row, i in enumerate(short):
        for j, c in enumerate(a[i]):
            masks[row, codes.get(c, len(codes))] |= one << np.uint64(j)
    sizes = np.array([len(b[i]) for i in short])
    letters = np.full((len(short), max(1, int(sizes.max()))), -1)
    for row, i in enumerate(short):
        letters[row, : len(b[i])] = [codes.get(c, len(codes)) for c in b[i]]
    state = np.full(len(short), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for j in range(letters.shape[1]):
            on = np.flatnonzero(letters[:, j] >= 0)
            m = masks[on, letters[on, j]]
            v = state[on]
            state[on] = (v + (v & m)) | (v & ~m)
    width = np.array([len(a[i]) for i in short], np.uint64)
    used = np.where(width == 64, np.iinfo(np.uint64).max, (one << (width % np.uint64(64))) - one)
    most[short] = np.bitwise_count(~state & used)
    return most


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Ratio of matching blocks (Ratcliff-Obershelp), as the standard library has it; null where it is certain to be below ``least``."""
    x, y = a.to_numpy(object), b.to_numpy(object)
    total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
    able = 2.0 * common_at_most(x, y) >= (least.to_numpy() - 1e-9) * total
    out = np.full(len(x), np.nan)
    for i in np.flatnonzero(able):
        out[i] = SequenceMatcher(None, x[i], y[i]).ratio()
    return pd.Series(out).where(able, None)


#: Letters by how rarely names hold them, rare ones first; others come before all.
RARE_FIRST = "qxvfjhguybldspmctkwzrnoeia 0123456789"


def _letters(key: Column) -> Column:
    """The key's characters as elements of a set, each with its number among equal ones, rare ones first."""
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    numbered = F.transform(chars, lambda c, i: F.struct(F.instr(F.lit(RARE_FIRST), c).alias("rank"), c.alias("c"), F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).alias("n")))
    return F.transform(F.array_sort(numbered), lambda e: F.concat(e["c"], e["n"].cast("string")))


def _alike_in_letters(asked: DataFrame, listed: DataFrame, cut: float) -> DataFrame:
    """Pairs (q, key) whose letters allow a similarity of ``cut``; asked has q, listed has key.

    The ratio of matching blocks is at most twice the common letters over both lengths.  With lengths a
    and b it takes cut * (a + b) / 2 common ones, of which there are a * cut / (2 - cut) at least, so pairs
    share one of the first a - that + 1 of each side's letters in an order that holds for both.
    """
    least = cut / (2 - cut)
    first = lambda df, c: df.withColumn("e", F.explode(F.slice(_letters(F.col(c)), F.lit(1), F.length(c) - F.ceil(F.length(c) * least - 1e-9).cast("int") + 1)))
    met = first(asked, "q").join(first(listed, "key"), "e").where(F.least(F.length("q"), F.length("key")) >= least * F.greatest(F.length("q"), F.length("key")) - 1e-9)
    return met.select("q", "key").distinct()


def suggest(queries: DataFrame, registry: DataFrame, k: int = 5, cut: float = 0.62, bonus: float = 0.15) -> DataFrame:
    """The ``k`` entries closest in spelling, distinct by key, best first; queries (query_id, key) of three letters at least.

    Keys that begin alike with four letters gain ``bonus``.  They meet on these letters, other pairs on
    letters that a ratio over the cut needs them to share; the ratio is worked out once for distinct keys.
    """
    asked = queries.where(F.length("key") >= 3).select("query_id", F.col("key").alias("q"))
    words, listed = asked.select("q").distinct(), registry.where("key <> ''").groupBy("key").agg(F.min("name").alias("name"))
    head = lambda c, n: F.left(c, F.lit(n))
    gain = F.when(F.col("key").startswith(head(F.col("q"), 4)) | F.col("q").startswith(head(F.col("key"), 4)), bonus).otherwise(0.0)
    # Keys of fewer than four letters are the whole of what must begin alike: they meet on each of their first letters' counts.
    begins = None
    for n in (1, 2, 3, 4):
        short = lambda c, n=n: F.length(c) == n if n < 4 else F.length(c) >= 4
        for x, y in ((words.where(short("q")), listed), (words, listed.where(short("key")))):
            met = x.withColumn("h", head(F.col("q"), n)).join(y.select("key", head(F.col("key"), n).alias("h")), "h").select("q", "key")
            begins = met if begins is None else begins.unionByName(met)
    pairs = begins.unionByName(_alike_in_letters(words, listed.select("key"), cut)).distinct()
    bound = 2 * F.least(F.length("q"), F.length("key")) / (F.length("q") + F.length("key"))
    scored = pairs.withColumn("gain", gain).where(bound + F.col("gain") >= cut).withColumn("ratio", similarity("q", "key", cut - F.col("gain")) + F.col("gain")).where((F.col("ratio") >= cut) & ~F.isnan("ratio"))
    found = asked.join(scored, "q").join(listed, "key")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ratio"), "name", "key"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "key", "name", "ratio")


def districts(queries: DataFrame, registry: DataFrame, k: int = 8, cut: float = 0.62, front: float = 0.35, within: float = 0.2) -> DataFrame:
    """The ``k`` districts that fit what was typed, best first; registry: entry_id, name, key, lat, line.

    Only districts with a position or a line count, and each is an answer of its own, also where keys are
    equal.  A key that begins with the query gains ``front``, one that holds it elsewhere ``within``.
    """
    asked = queries.where(F.length("key") >= 3).select("query_id", F.col("key").alias("q"))
    placed = registry.where(T.is_district(F.col("name")) & (F.col("lat").isNotNull() | (F.size("line") > 0))).select("entry_id", "name", "key")
    words, listed = asked.select("q").distinct(), placed.select("key").distinct()
    # A key that holds the query holds its rarest letter, with its number or a higher one of the same letter, so also that number.
    holding = words.withColumn("e", F.get(_letters(F.col("q")), F.lit(0))).join(listed.withColumn("e", F.explode(_letters(F.col("key")))), "e").where(F.col("key").contains(F.col("q"))).select("q", "key")
    pairs = holding.unionByName(_alike_in_letters(words, listed, cut)).distinct()
    gain = F.when(F.col("key").startswith(F.col("q")), front).when(F.col("key").contains(F.col("q")), within).otherwise(0.0)
    scored = pairs.withColumn("ratio", similarity("q", "key", cut - gain) + gain).where((F.col("ratio") >= cut) & ~F.isnan("ratio"))
    # What was typed is ranked once, however many typed it, and of equal keys the first ``k`` can be among its best.
    first = lambda df, by, *order: df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)
    best = first(scored.join(first(placed, "key", "name", "entry_id").drop("place"), "key"), "q", F.desc("ratio"), "name", "entry_id")
    return asked.join(best, "q").select("query_id", "place", "entry_id", "key", "name", "ratio")


def sync_reference(source: DataFrame, target: DataFrame, columns: Sequence[str], key: str = "slug") -> DataFrame:
    """What an authoritative file makes of a table: ``insert``, ``update`` or ``same`` (rows only stored are left)."""
    s = source.select(key, *(F.col(c).alias(f"s_{c}") for c in columns), F.lit(True).alias("in_s"))
    t = target.select(key, *(F.col(c).alias(f"t_{c}") for c in columns), F.lit(True).alias("in_t"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}"))
    action = F.when(F.col("in_t").isNull(), "insert").when(F.col("in_s").isNull(), "kept").when(same, "same").otherwise("update")
    return s.join(t, key, "full_outer").select(key, *(F.when(F.col("in_s"), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in columns), action.alias("action"))


# Facts


def parse_facts(items: DataFrame) -> DataFrame:
    """Items (answer_id, pos, topic, key, value, source_url, source_title, confidence) with ``reason`` why each is rejected, null if kept.

    Reasons in order: topic, empty key or value, source, then a duplicate of an earlier kept (topic, key).
    """
    cut = lambda c, n: F.trim(F.left(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(n)))
    rows = items.withColumns({"topic": F.lower(cut("topic", 60)), "key": cut("key", 60), "value": cut("value", 300), "source_url": cut("source_url", 500), "source_title": cut("source_title", 200), "confidence": F.lower(cut("confidence", 10))})
    rows = rows.withColumn("confidence", F.when(F.col("confidence").isin(*T.CONFIDENCES), F.col("confidence")).otherwise("low"))
    rows = rows.withColumn("source_title", F.when(F.col("source_title") == "", F.regexp_extract("source_url", r"^https?://([^/?#]*)", 1)).otherwise(F.col("source_title")))
    reason = F.when(~F.col("topic").isin(*T.TOPICS), "unknown topic").when((F.col("key") == "") | (F.col("value") == ""), "empty key or value").when(~T.usable_source(F.col("source_url")), "no usable source")
    rows = rows.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("answer_id", "topic", F.lower("key"), F.col("reason").isNull()).orderBy("pos"))
    return rows.withColumn("_p", place).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_p") > 1), "duplicate").otherwise(F.col("reason"))).drop("_p")


def supersede(passes: DataFrame, facts: DataFrame, key: str = "site_id") -> DataFrame:
    """Facts with the time at which the site's next pass, even an empty one, closed them; null while they stand."""
    nxt = passes.select(key, "pass_at").distinct().withColumn("superseded_at", F.lead("pass_at").over(Window.partitionBy(key).orderBy("pass_at")))
    return facts.join(nxt, [key, "pass_at"])


def standing(facts: DataFrame, lang: str, key: str = "site_id") -> DataFrame:
    """Standing facts in a language (none stated: en), or in English where the site has none, in topic order."""
    rows = facts.where("superseded_at is null").withColumn("lang", F.coalesce("lang", F.lit("en")))
    has = F.max((F.col("lang") == lang).cast("int")).over(Window.partitionBy(key))
    rows = rows.withColumn("_has", has).where(F.when(F.col("_has") == 1, F.col("lang") == lang).otherwise(F.col("lang") == "en"))
    return rows.withColumn("topic_order", F.array_position(F.array(*[F.lit(t) for t in T.TOPICS]), F.col("topic"))).drop("_has")
