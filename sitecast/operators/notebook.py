"""Sessions, catches, rates and limits.  A blank session is data: it stays in every count with a catch of zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecast.operators.scans import ordinal_ranks
from sitecast.sources.scratch import kept


def effort_minutes(started: Column, ended: Column) -> Column:
    """Whole minutes, one at least; null while the session is open.  Both in epoch seconds."""
    return F.when(ended.isNotNull(), F.greatest(F.lit(1), F.floor((ended - started) / 60)))


def with_catch(sessions: DataFrame, catches: DataFrame) -> DataFrame:
    """Fish by session: catches are summed before the join, sessions without any count 0."""
    fish = catches.groupBy("session_id").agg(F.sum("count").alias("fish"))
    return sessions.join(fish, "session_id", "left").withColumn("fish", F.coalesce("fish", F.lit(0))).withColumn("is_blank", F.col("fish") == 0)


def catch_rate(fish: str = "fish", minutes: str = "effort_minutes") -> Column:
    """Fish an hour, two places; 0 without effort."""
    hours = F.coalesce(F.col(minutes), F.lit(0)) / 60
    return F.when(hours > 0, F.bround(F.col(fish) / hours, 2)).otherwise(0.0)


def water_type(raw: Column) -> Column:
    """``pzw`` or ``commercial``, else null."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin("pzw", "commercial"), low)


def mean_rate(rated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean rate by ``keys`` (column rate, blanks included); refused where types mix or one is unset."""
    out = rated.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("rate").alias("mean"), F.count_distinct("water_type").alias("types"), F.count_if(F.col("water_type").isNull()).alias("unset"))
    refusal = F.when(F.col("unset") > 0, "type unset").when(F.col("types") > 1, "types mixed")
    return out.select(*keys, "n", F.when(refusal.isNull(), F.col("mean")).alias("mean_rate"), refusal.alias("refusal"))


def visit_stats(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ended sessions, blanks among them and the last visit."""
    return sessions.where("ended_at is not null").groupBy(*keys).agg(F.count("*").alias("sessions"), F.count_if("is_blank").alias("blanks"), F.max("started_at").alias("last_visit"))


def newest_sessions(sessions: DataFrame, keys: Sequence[str], n: int = 50) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("started_at"), F.desc("session_id"))
    return sessions.where("ended_at is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def open_sessions(sessions: DataFrame, key: str = "user_id") -> DataFrame:
    """Open sessions, newest first: which is the active one, and whether there are several at once."""
    w = Window.partitionBy(key)
    newest = F.row_number().over(w.orderBy(F.desc("started_at"), F.desc("session_id")))
    return sessions.where("ended_at is null").withColumn("place", newest).withColumn("is_active", F.col("place") == 1).withColumn("overlaps", F.count("*").over(w) > 1)


def weight_per_day(sessions: DataFrame, catches: DataFrame, register: DataFrame, key: str = "site_id", min_minutes: int = 1) -> DataFrame:
    """Kilograms per angler-day, own record against the register's newest season; sites with neither are left out."""
    kilos = catches.groupBy("session_id").agg(F.sum(F.col("count") * F.col("weight_g") / 1000.0).alias("kg"))
    own = sessions.where("ended_at is not null").join(kilos, "session_id", "left").groupBy(key).agg(F.sum(F.coalesce("kg", F.lit(0.0))).alias("kg"), F.sum(F.greatest(F.coalesce("effort_minutes", F.lit(0)), F.lit(min_minutes)) / 1440.0).alias("days"))
    newest = register.groupBy(key).agg(F.max_by("kg_per_angler_day", "year").alias("register_rate"))
    both = own.withColumn("own_rate", F.col("kg") / F.col("days")).join(newest, key, "full_outer").where("own_rate is not null or register_rate is not null")
    ratio = F.try_divide("own_rate", "register_rate")
    return both.select(key, "own_rate", "register_rate", ratio.alias("ratio"), F.when(ratio.isNull(), "one side only").when(ratio >= 1, "at or above").otherwise("below").alias("verdict"))


def leg_rates(legs: DataFrame, catches: DataFrame) -> DataFrame:
    """Fish an hour by leg, empty legs kept, null without a length."""
    fish = catches.groupBy("leg_id").agg(F.sum("count").alias("fish"))
    hours = (F.col("to_ts") - F.col("from_ts")) / 3600.0
    return legs.withColumn("hours", hours).join(fish, "leg_id", "left").withColumn("fish", F.coalesce("fish", F.lit(0))).withColumn("rate", F.try_divide(F.col("fish").cast("double"), F.col("hours")))


def zone_coverage(legs: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Legs and hours by zone, the confidence band (low to 4, medium to 15, high from 16 legs), and the bonus of under ten hours."""
    out = legs.groupBy(zone).agg(F.count("*").alias("legs"), F.sum(F.coalesce((F.col("to_ts") - F.col("from_ts")) / 3600.0, F.lit(0.0))).alias("hours"))
    return out.withColumn("confidence", F.when(F.col("legs") <= 4, "low").when(F.col("legs") <= 15, "medium").otherwise("high")).withColumn("bonus", F.when(F.col("hours") < 10, 0.8).otherwise(0.0))


def grouped_rate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fish, hours and rate by any keys: sums first, one division after."""
    return rows.groupBy(*keys).agg(F.sum("fish").alias("fish"), F.sum("hours").alias("hours"), F.count("*").alias("n")).withColumn("rate", F.try_divide(F.col("fish").cast("double"), F.col("hours")))


def preferences(sites: DataFrame, prefs: DataFrame, user: Column, key: str = "site_id") -> DataFrame:
    """Every site with the user's flags, false where none is stored."""
    own = prefs.where(F.col("user_id") == user).select(key, "is_favourite", F.col("removed_at").isNotNull().alias("is_removed"))
    return sites.join(own, key, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_favourite", "is_removed")})


def site_cards(sites: DataFrame, latest: DataFrame, stats: DataFrame, key: str = "site_id") -> DataFrame:
    """Active sites with their newest score and visits; ``place`` puts favourites first, then names."""
    rows = sites.where("not is_removed").join(latest, key, "left").join(stats, key, "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("is_favourite"), F.lower("name"), key)))


def search_names(species: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows of which any name contains the query, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return species.where(hit)


def trailing_quota(adds: DataFrame, limit: int = 5, window: int = 86400, key: str = "user_id") -> DataFrame:
    """At each add: how many in the trailing window, what remains, and when the oldest of them falls out."""
    w = Window.partitionBy(key).orderBy("ts").rangeBetween(-window, 0)
    return adds.withColumn("used", F.count("*").over(w)).withColumn("remaining", F.greatest(F.lit(0), limit - F.col("used"))).withColumn("resets_at", F.min("ts").over(w) + window)


#: Rule, keys, failures allowed, window in seconds; in the order in which they are tried.
LIMITS = (("pair", ("email", "ip"), 5, 900), ("email", ("email",), 20, 3600), ("ip", ("ip",), 30, 900))


def _cleared(attempts: DataFrame, widest: int) -> DataFrame:
    """Failures (attempt_id, email, ip, ts, cleared): when the next success of the email comes, if that is within the ``widest`` window.

    An email's history is cut into stretches of time; successes early in one also stand at the end of the one before.
    """
    length = 4 * widest
    own = attempts.where("email is not null").select("attempt_id", "email", "ip", "ts", "ok", F.floor(F.col("ts") / length).alias("part"), F.lit(True).alias("own"))
    ahead = own.where(F.col("ok") & (F.col("ts") - F.col("part") * length <= widest)).withColumn("part", F.col("part") - 1).withColumn("own", F.lit(False))
    after = Window.partitionBy("email", "part").orderBy(F.desc("ts"), F.desc("attempt_id")).rowsBetween(Window.unboundedPreceding, -1)
    found = own.unionByName(ahead).withColumn("cleared", F.min(F.when(F.col("ok"), F.col("ts"))).over(after)).where("own and not ok").select("attempt_id", "email", "ip", "ts", "cleared")
    # Attempts without an email are kept out of the window: they are one key, and nothing clears them.
    bare = attempts.where("email is null and not ok").select("attempt_id", "email", "ip", "ts", F.lit(None).cast("long").alias("cleared"))
    return found.unionByName(bare)


def _breached(failures: DataFrame, keys: Sequence[str], most: int, width: int) -> DataFrame:
    """(attempt_id, wait) of the failures that find ``most`` earlier ones of their keys live.

    A failure is live for instants in (ts, end], end being where its window ends or it is cleared.  In the order of
    time, a running sum of starts and ends counts the live ones at each failure.  The oldest of them is the first whose end
    is not before now: among starts in order the running maximum of the ends never falls, so the smallest start whose
    maximum reaches now is the one, a running minimum in falling order of the maxima.  Two sorts of a stretch of time of
    one key; a stretch also holds the starts of the window before it.
    """
    length = 4 * width
    end = F.least(F.col("ts") + width, F.coalesce(F.col("cleared") - 1, F.col("ts") + width))
    live = failures.dropna(subset=list(keys)).select("attempt_id", *keys, "ts", end.alias("end"), F.floor(F.col("ts") / length).alias("part"))
    event = lambda t, kind, delta: F.struct(F.col(t).alias("t"), F.lit(kind).alias("kind"), F.lit(delta).alias("delta"))
    span = F.array(event("ts", 1, 1), event("end", 2, -1))
    asked = live.select("attempt_id", *keys, "ts", "end", "part", F.explode(F.when(F.col("end") > F.col("ts"), F.array_append(span, event("ts", 0, 0))).otherwise(F.array(event("ts", 0, 0)))).alias("e"))
    ahead = live.where((F.col("end") > F.col("ts")) & (F.col("ts") >= (F.col("part") + 1) * length - width)).select("attempt_id", *keys, "ts", "end", (F.col("part") + 1).alias("part"), F.explode(span).alias("e"))
    rows = asked.unionByName(ahead).select("attempt_id", *keys, "part", "ts", "end", "e.*")
    by = [*keys, "part"]
    told = Window.partitionBy(*by).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("n", F.sum("delta").over(told)).withColumn("reach", F.max(F.when(F.col("kind") == 1, F.col("end"))).over(told))
    reach = F.when(F.col("kind") == 1, F.col("reach")).otherwise(F.col("t"))
    due = counted.where((F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("n") >= most))).withColumn("reach", reach)
    falling = Window.partitionBy(*by).orderBy(F.desc("reach"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    oldest = due.withColumn("oldest", F.min(F.when(F.col("kind") == 1, F.col("ts"))).over(falling)).where("kind = 0")
    return oldest.select("attempt_id", (F.col("oldest") + width - F.col("ts")).alias("wait"))


def limiter(attempts: DataFrame, limits: Sequence[tuple] = LIMITS) -> DataFrame:
    """The rule that each failed attempt finds breached by earlier failures, and the seconds to wait.

    attempts: attempt_id (unique), email, ip, ts (epoch seconds), ok.  A success clears the earlier failures of its
    email, for every rule.  A failure counts in [ts - window, ts); one without the rule's key counts for
    nothing.  No attempt meets another: each rule is sorted by key and stretch of time, so a million attempts of one
    address take a sort, and a key's history is as many tasks as it has stretches.
    """
    failures = _cleared(attempts, max(width for *_, width in limits))
    found = [_breached(failures, keys, most, width).select("attempt_id", F.lit(i).alias("place"), F.lit(name).alias("rule"), "wait") for i, (name, keys, most, width) in enumerate(limits)]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    first = every.groupBy("attempt_id").agg(F.min_by(F.struct("rule", "wait"), "place").alias("r"))
    return first.select("attempt_id", "r.rule", F.col("r.wait").alias("retry_after"))


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str, order: str) -> DataFrame:
    """Rank correlation of two scores within each group, on ordinal ranks (ties by ``order``); null for one row."""
    own = kept(rows.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), F.col(order).alias("o")), "scores")
    ranked = ordinal_ranks(own, keys, {"_x": "x", "_y": "y"}, "o")
    d2 = F.sum((F.col("_x") - F.col("_y")) * (F.col("_x") - F.col("_y")))
    n = F.count("*")
    return ranked.groupBy(*keys).agg(n.alias("n"), F.when(n > 1, 1 - 6 * d2 / (n * (n * n - 1))).alias("rho"))


def outcome(predictions: DataFrame, rated: DataFrame) -> DataFrame:
    """Rated sessions with the score predicted for them beforehand."""
    return rated.join(predictions.select("prediction_id", "ruleset", "day_score", "contributions"), "prediction_id")


def rule_hits(outcomes: DataFrame, good_rate: float) -> DataFrame:
    """By rule and ruleset version: how often a positive contribution met a good rate, with its sample size."""
    each = outcomes.select("ruleset", "rate", F.explode("contributions").alias("rule", "part"))
    return each.where("part > 0").groupBy("rule", "ruleset").agg(F.count("*").alias("n"), F.avg((F.col("rate") >= good_rate).cast("double")).alias("hit_rate"))
