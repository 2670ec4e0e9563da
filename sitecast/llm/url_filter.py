"""URL filters with link-graph propagation (op 13).

Rules (host and path prefix) judge the urls they fit, the longest first.  The others are judged by their
host: personalised PageRank carries trust from hosts with allowed pages along host edges, and distrust
from hosts with blocked pages against them, and a host whose distrust is high and above its trust is blocked.

Edges are hyperlinks between different hosts, counted by pairs of hosts, and one in both directions between a host
and the host that its name is a subdomain of.  PageRank is summed as a series: the mass that k steps bring
is the mass of k - 1 steps over the edges, so a round is one join and one sum, combined before its shuffle;
hosts without edges keep their seeds and take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import delete, materialize

#: (allow?, host, path)
RULES = (
    (True, "com", "/"),
    (False, "example.com", "/en/"),
    (True, "www.example.com", "/en/"),
    (False, "net", "/es/"),
    (False, "net", "/fr/"),
)


@dataclass(frozen=True)
class LinkParams:
    damping: float = 0.85
    rounds: int = 24
    #: Share of a host's pages, or as much mass from elsewhere, that must be distrusted before it is blocked.
    threshold: float = 0.25
    #: Weight of the edges between a host and the one above it, in links.
    kin: float = 1.0


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of anchors that name a host; each run ends at the next tag, so a page is read once.
_LINK = r"""(?i)<a\b[^<>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and whether it allows; both null if none does."""
    text = verdict = None
    for allow, own, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        text = (F.when if text is None else text.when)(fits, f"{own}{prefix}")
        verdict = (F.when if verdict is None else verdict.when)(fits, allow)
    nothing = F.lit(None)
    return (nothing.cast("string"), nothing.cast("boolean")) if text is None else (text, verdict)


def _parsed(pages: DataFrame, rules: tuple) -> DataFrame:
    """(page_id, url, host, path, rule, allowed) of every row."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    parts = own.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    text, allowed = rule_of(F.col("host"), F.col("path"), rules)
    return parts.withColumns({"rule": text, "allowed": allowed})


def seeds(parsed: DataFrame) -> DataFrame:
    """(host, trust, distrust): the shares of a host's pages that rules allow and block; hosts without a name are left out."""
    share = lambda allowed: F.avg(F.coalesce(F.when(allowed, 1.0), F.lit(0.0)))
    return parsed.where("host <> ''").groupBy("host").agg(share(F.col("allowed")).alias("trust"), share(~F.col("allowed")).alias("distrust"))


def host_edges(pages: DataFrame, hosts: DataFrame, params: LinkParams) -> DataFrame:
    """(src, dst, links) between different hosts."""
    found = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))
    names = hosts.select(F.col("host").alias("above"))
    kin = hosts.select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("above")).where("instr(host, '.') > 0").join(names, "above")
    kin = kin.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("above").alias("dst")), F.struct(F.col("above").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*", F.lit(params.kin).alias("links"))
    return found.unionByName(kin).groupBy("src", "dst").agg(F.sum("links").alias("links"))


def _moves(edges: DataFrame) -> DataFrame:
    """(forward, src, dst, w): where a unit of trust goes along the edges, and a unit of distrust against them.

    A host that mass can't leave keeps it.
    """
    sides = []
    for forward, src, dst in ((True, "src", "dst"), (False, "dst", "src")):
        own = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "links")
        total = own.groupBy("src").agg(F.sum("links").alias("total"))
        stuck = own.select(F.col("dst").alias("src")).distinct().join(total.select("src"), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w"))
        sides.append(own.join(total, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("w")).unionByName(stuck).select(F.lit(forward).alias("forward"), "src", "dst", "w"))
    return sides[0].unionByName(sides[1])


def host_scores(pages: DataFrame, parsed: DataFrame, params: LinkParams = LinkParams()) -> tuple[DataFrame, list[DataFrame]]:
    """(host, trust, distrust) after propagation, for every host of a page or a link that has any; and the written tables it reads."""
    start = materialize(seeds(parsed), "host-seeds")
    edges = materialize(host_edges(pages, start, params), "host-edges")
    moves = materialize(_moves(edges), "host-moves")
    ends = moves.select(F.col("src").alias("host")).distinct()
    long = start.select("host", F.explode(F.create_map(F.lit(True), F.col("trust"), F.lit(False), F.col("distrust"))).alias("forward", "mass")).where("mass > 0")
    still = long.join(ends, "host", "left_anti").select("host", "forward", "mass")
    front = long.join(ends, "host", "left_semi").select("host", "forward", (F.col("mass") * (1 - params.damping)).alias("mass"))
    front = materialize(front, "host-mass")
    scores, done = still.unionByName(front), [start, moves, front]
    moving = bool(front.limit(1).count())
    for k in range(params.rounds if moving else 0):
        step = front.join(moves, (front["host"] == moves["src"]) & (front["forward"] == moves["forward"]))
        step = step.groupBy(F.col("dst").alias("host"), front["forward"].alias("forward")).agg(F.sum(F.col("mass") * F.col("w") * params.damping).alias("mass"))
        front = materialize(step, "host-mass")
        scores = scores.unionByName(front)
        done.append(front)
        if k % 8 == 7:  # rounds that are summed no longer stand one by one
            summed = materialize(scores.groupBy("host", "forward").agg(F.sum("mass").alias("mass")), "host-scores")
            for x in done[2:-1]:
                delete(x)
            scores, done = summed, [start, moves, front, summed]
    delete(edges)
    total = lambda forward: F.round(F.sum(F.when(F.col("forward") == F.lit(forward), F.col("mass")).otherwise(0.0)), 9)
    return scores.groupBy("host").agg(total(True).alias("trust"), total(False).alias("distrust")), done


def judge(pages: DataFrame, rules: tuple = RULES, params: LinkParams = LinkParams()) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed: nothing speaks
    against it.  A url that no rule fits is blocked if its host's distrust is ``threshold`` at least and above its trust.  Null pages have no
    links; repeated rows count each and give repeated rows; an empty table gives no rows; other columns are ignored.
    """
    parsed = _parsed(pages, rules)
    scores, written = host_scores(pages, parsed, params)
    bad = materialize(scores.where((F.col("distrust") >= params.threshold) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("bad")), "bad-hosts")
    for x in written:
        delete(x)
    met = parsed.join(bad, (parsed["host"] == bad["bad"]) & parsed["allowed"].isNull(), "left")
    verdict = F.when(F.coalesce(F.col("allowed"), F.col("bad").isNull()), "allow").otherwise("block")
    return met.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
