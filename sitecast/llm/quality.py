"""Quality rules with robust multivariate outliers (op 10), in DataFrame and SQL functions alone.

Each document becomes a vector of transformed text statistics.  For every language and source the
minimum-covariance-determinant estimate of mean and covariance is approached by concentration steps from
three deterministic starts: coordinate-wise medians and spreads, the moments of all rows, and the spatial
signs around the medians.  In a step the documents with the smallest Mahalanobis distances (a share ``core``
of the group) give the next mean and covariance; of the three results the one with the smallest
determinant stands.  Documents far off by it go.

A step is one pass: the sums that make moments are gathered by group, start and narrow bins of the distance
(``bins`` to an octave), and the nearest bins that hold the share count, the last of them in part.

A group's estimate is blended with that of all documents as if ``prior`` documents more had shown the
latter, at every group size, so verdicts don't turn where a group passes some size.  All estimates are
aggregates that are combined before the shuffle, and rows meet them broadcast or over salted keys, so no task
gathers a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecast.llm.common import delete, materialize

SPACE = r"[ \x09-\x0D]+"
#: The vector: word length, symbols, repeated lines, repeated words, capitals and exclamation marks.
FEATURES = ("x_length", "x_symbols", "x_lines", "x_repeats", "x_capitals", "x_marks")


@dataclass(frozen=True)
class QualityParams:
    core: float = 0.75
    steps: int = 3
    #: Bins of distances to an octave, from 2 ** -10 on.
    bins: int = 16
    #: Documents of all groups that a group's estimate is blended with.
    prior: float = 200.0
    #: Median of the chi-square distribution of six degrees of freedom, which ``scale`` refers to, and the distance
    #: that it exceeds with a chance of 4e-15: documents as normal ones are in no corpus go beyond it.
    median: float = 5.348
    cutoff: float = 80.0
    #: Least standard deviation that a coordinate counts with, about what one event more makes of a text of some
    #: hundred words: a symbol or mark in 400 (the root of 1 / 400), a capital in 400 letters, one of 16 lines or of
    #: 16 words repeated, a third of a letter in the mean word.
    floors: tuple[float, ...] = (0.35, 0.05, 0.06, 0.06, 0.05, 0.04)
    #: Estimates of up to so many rows (some hundred bytes each) are broadcast; beyond, rows of one group meet theirs in ``salts`` tasks.
    small: int = 10_000
    salts: int = 64


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics of its texts (null: no words) and the features beside doc_id, lang and source.

    Words are runs of characters other than ASCII white space.  The windows of three words are hashed to 64
    bits; equal hashes are neighbours once they are sorted.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda x: x != ""))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("hashes", F.expr("case when n >= 3 then transform(sequence(0, n - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))) else cast(array() as array<bigint>) end"))
    rows = rows.select("doc_id", "lang", "source", "text", "n", "hashes", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.expr("size(hashes) > size(array_distinct(hashes))").alias("repeats"))
    # Windows whose hashes agree in the high bits, the position in the low ones; then those whose whole hashes agree.
    rows = rows.withColumn("bits", F.expr("cast(ceil(log2(n + 1)) as int) + 1"))
    rows = rows.withColumn("sorted", F.expr("case when repeats then sort_array(transform(hashes, (h, i) -> shiftleft(shiftright(h, bits), bits) + i)) end"))
    rows = rows.withColumn("likely", F.expr("""case when repeats then sort_array(transform(
        filter(transform(sorted, (h, i) -> struct(h as h, shiftright(h, bits) = shiftright(get(sorted, i - 1), bits) or shiftright(h, bits) = shiftright(get(sorted, i + 1), bits) as twice)), x -> x.twice),
        x -> struct(get(hashes, cast(x.h - shiftleft(shiftright(x.h, bits), bits) as int)) as h, x.h - shiftleft(shiftright(x.h, bits), bits) as i))) end"""))
    rows = rows.withColumn("places", F.expr("case when repeats then sort_array(transform(filter(transform(likely, (x, k) -> struct(x.i as i, x.h = get(likely, k - 1).h or x.h = get(likely, k + 1).h as twice)), x -> x.twice), x -> x.i)) end"))
    repeated = F.expr("coalesce(aggregate(transform(places, (p, i) -> least(3L, coalesce(get(places, i + 1) - p, 3L))), 0L, (s, x) -> s + x), 0L)")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    rows = rows.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"), repeated.alias("n_repeat_words"), F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"), F.regexp_count("text", F.lit("!")).alias("marks"))
    rows = rows.withColumn("n_dup_lines", F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("x_length"), F.sqrt(F.col("n_symbols") / words).alias("x_symbols"),
        (F.col("n_dup_lines") / F.greatest(F.size("lines"), F.lit(1))).alias("x_lines"), (F.col("n_repeat_words") / words).alias("x_repeats"),
        F.sqrt(F.col("capitals") / chars).alias("x_capitals"), F.sqrt(F.col("marks") / words).alias("x_marks"),
    )


#: Coordinates and their pairs.  The long lists of expressions below are SQL, each parsed in one call.
K = range(len(FEATURES))
PAIRS = [(i, j) for i in K for j in K if i <= j]


def _with_factor(est: DataFrame, p: QualityParams) -> DataFrame:
    """``est`` (means m_i, covariances c_i_j) with the Cholesky factor l_i_j, whose columns build on each other, instead of the covariances."""
    made = []
    for i in K:
        for j in range(i + 1):
            rest = " - ".join([f"c_{j}_{i}", *(f"l_{i}_{m} * l_{j}_{m}" for m in range(j))])
            least = p.floors[i] ** 2
            made.append(f"sqrt(greatest({rest} + {least!r}D, {least / 4!r}D)) as l_{i}_{i}" if i == j else f"({rest}) / l_{j}_{j} as l_{i}_{j}")
    covariances = {f"c_{i}_{j}" for i, j in PAIRS}
    return est.selectExpr(*(c for c in est.columns if c not in covariances), *made)


def _blended(est: DataFrame, p: QualityParams) -> DataFrame:
    """``est`` (g, start, size, m_i, c_i_j) with each group's moments blended with those of all rows (g empty) of the same start."""
    every = est.where("g = ''").selectExpr("start", *(f"m_{i} as am_{i}" for i in K), *(f"c_{i}_{j} as ac_{i}_{j}" for i, j in PAIRS))
    met = est.join(F.broadcast(every), "start").withColumn("own", F.expr(f"case when g = '' then 1D else size / (size + {p.prior!r}D) end"))  # one row a start
    # Means of other names until the spreads, which go by the unblended ones, are made.
    means = [f"own * m_{i} + (1 - own) * am_{i} as b_{i}" for i in K]
    spread = [f"own * c_{i}_{j} + (1 - own) * ac_{i}_{j} + own * (1 - own) * (m_{i} - am_{i}) * (m_{j} - am_{j}) as c_{i}_{j}" for i, j in PAIRS]
    return met.selectExpr("g", "start", "size", *means, *spread).withColumnsRenamed({f"b_{i}": f"m_{i}" for i in K})


def _meet(rows: DataFrame, est: DataFrame, few: bool, p: QualityParams) -> DataFrame:
    """``rows`` with the estimates of their group: broadcast where they are counted to be few, else met over salted keys, so that a hot group is spread."""
    if few:
        return rows.join(F.broadcast(est), "g")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(p.salts)))
    return salted.join(est.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.salts - 1).cast("long")))), ["g", "salt"]).drop("salt")


def _distance(rows: DataFrame) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance d2, by forward substitution: the columns build on each other."""
    made = [f"({' - '.join([f'({x} - m_{i})', *(f'l_{i}_{j} * z_{j}' for j in range(i))])}) / l_{i}_{i} as z_{i}" for i, x in enumerate(FEATURES)]
    return rows.selectExpr("*", *made, " + ".join(f"z_{i} * z_{i}" for i in K) + " as d2")


def _sums(weight: str = "") -> list[Column]:
    """The count n and sums s_i, s_i_j of the features and their products; with ``weight``, of such sums."""
    if weight:
        return [F.expr(f"sum({x} * {weight}) as {x}") for x in ("n", *(f"s_{i}" for i in K), *(f"s_{i}_{j}" for i, j in PAIRS))]
    return [F.expr(x) for x in ("count(*) as n", *(f"sum({x}) as s_{i}" for i, x in enumerate(FEATURES)), *(f"sum({FEATURES[i]} * {FEATURES[j]}) as s_{i}_{j}" for i, j in PAIRS))]


def _moments() -> list[str]:
    """Means m_i and covariances c_i_j of such sums."""
    return [f"s_{i} / n as m_{i}" for i in K] + [f"s_{i}_{j} / n - (s_{i} / n) * (s_{j} / n) as c_{i}_{j}" for i, j in PAIRS]


def group_key() -> Column:
    return F.concat_ws("\x01", F.coalesce("lang", F.lit("\x02")), F.coalesce("source", F.lit("\x02")))


def _starts(rows: DataFrame, seen: DataFrame, few: bool, p: QualityParams) -> DataFrame:
    """The moments (g, start, size, m_i, c_i_j) of the three starts, from counts, sums and quartiles of the groups."""
    spread = lambda i: f"pow((q_{i}[2] - q_{i}[0]) / 1.349D, 2)"
    middle = seen.selectExpr("g", "0 as start", "n as size", *(f"q_{i}[1] as m_{i}" for i in K), *(f"{spread(i) if i == j else '0D'} as c_{i}_{j}" for i, j in PAIRS))
    # Signs: directions from the medians, in units of the spreads, as long as one.
    units = _blended(middle, p).selectExpr("g", "size", *(f"m_{i}" for i in K), *(f"sqrt(c_{i}_{i} + {p.floors[i] ** 2!r}D) as u_{i}" for i in K))
    away = _meet(rows, units.drop("size"), few, p).selectExpr("g", *(f"({x} - m_{i}) / u_{i} as d_{i}" for i, x in enumerate(FEATURES)))
    away = away.selectExpr("*", " + ".join(f"d_{i} * d_{i}" for i in K) + " + 1e-12D as square")
    signs = away.groupBy("g").agg(*(F.expr(f"avg(d_{i} * d_{j} / square) as v_{i}_{j}") for i, j in PAIRS)).join(units, "g")
    signs = signs.selectExpr("g", "2 as start", "size", *(f"m_{i}" for i in K), *(f"v_{i}_{j} * u_{i} * u_{j} * {len(FEATURES)} as c_{i}_{j}" for i, j in PAIRS))
    return middle.unionByName(seen.selectExpr("g", "1 as start", "n as size", *_moments())).unionByName(signs)


def _concentrated(rows: DataFrame, est: DataFrame, few: bool, p: QualityParams) -> DataFrame:
    """The moments of each group's and start's nearest rows, a share ``core`` of them, by ``est``."""
    binned = _distance(_meet(rows, est, few, p)).groupBy("g", "start", F.expr(f"floor(log2(greatest(d2, pow(2D, -10))) * {p.bins}) as bin")).agg(*_sums())
    own = Window.partitionBy("g", "start")
    binned = binned.withColumns({"size": F.sum("n").over(own), "upto": F.sum("n").over(own.orderBy("bin"))})
    core = binned.withColumn("part", F.expr(f"least(1D, (size * {p.core!r}D - upto + n) / n)")).where("part > 0")
    return core.groupBy("g", "start").agg(F.first("size").alias("size"), *_sums("part")).selectExpr("g", "start", "size", *_moments())


def estimates(stats: DataFrame, p: QualityParams) -> tuple[DataFrame, bool]:
    """A row for each group of rows, and one with an empty key for all: g, means, factor, and ``scale``, which makes the median distance that of chi-square.

    With them, whether they are few enough to be broadcast.
    """
    # Every row counts for its group and for all.
    rows = stats.select(F.explode(F.array(group_key(), F.lit(""))).alias("g"), *FEATURES)
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    seen = materialize(rows.groupBy("g").agg(*_sums(), *(F.percentile_approx(x, quarters, 2000).alias(f"q_{i}") for i, x in enumerate(FEATURES))), "estimates")
    groups = seen.count()
    few = 3 * groups <= p.small
    # Every estimate comes from a few hundred bins at most.
    kept = lambda est: materialize(est, "estimates", 3 * groups * 16 * p.bins)
    made = [seen, kept(_starts(rows, seen, few, p))]
    for _ in range(p.steps):
        made.append(kept(_concentrated(rows, _with_factor(_blended(made[-1], p), p), few, p)))
    est = _with_factor(_blended(made[-1], p), p)
    volume = F.expr(f"round({' + '.join(f'ln(l_{i}_{i})' for i in K)}, 9)")
    lowest = F.min_by(F.struct(*(c for c in est.columns if c not in ("g", "start"))), F.struct(volume, F.col("start"))).alias("e")
    best = kept(est.groupBy("g").agg(lowest).select("g", "e.*"))
    scale = kept(_distance(_meet(rows, best, few, p)).groupBy("g").agg((F.percentile_approx("d2", 0.5, 2000) / p.median).alias("scale")))
    for df in made:
        delete(df)
    # A group's scale is blended as its moments are.
    every = scale.where("g = ''").select(F.col("scale").alias("all_scale"))
    own = F.col("size") / (F.col("size") + p.prior)
    scaled = best.join(scale, "g").join(F.broadcast(every), F.lit(True))  # one row
    return scaled.withColumn("scale", F.greatest(own * F.col("scale") + (1 - own) * F.col("all_scale"), F.lit(1.0))).drop("all_scale", "size"), few


def judge(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): the base statistics, base_failed, distance and kept.

    Null texts have no words and fail; a null language or source is a group of its own; an empty table
    gives no rows; repeated rows are judged alike; other columns are ignored.  ``distance`` is null where
    base_failed.
    """
    stats = materialize(statistics(docs), "statistics")
    stats = stats.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    passed = stats.where("not base_failed")
    est, few = estimates(passed, p)
    far = _distance(_meet(passed.withColumn("g", group_key()), est, few, p)).withColumn("distance", F.col("d2") / F.col("scale"))
    base = [c for c in stats.columns if c not in FEATURES and c not in ("lang", "source")]
    good = far.select(*base, "distance", (F.col("distance") <= p.cutoff).alias("kept"))
    return good.unionByName(stats.where("base_failed").select(*base, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


def keep(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` with all their columns whose id has no row that is rejected."""
    bad = judge(docs, p).where("not kept").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
