"""Weak signals, bursts and trends over term counts and time (N1-N16, G13, G15-G18, F16-F18, X32-X40 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import graph
from quarry.session import checkpointed, small_batches

SOURCES = 4


def month_windows(spark: SparkSession, period_from: str, period_to: str, lookback: int = 12, step: int = 1) -> DataFrame:
    """Calendar windows (idx, label, start, end, is_history) from the lookback on to the period's last month."""
    first = F.add_months(F.trunc(F.lit(period_from).cast("date"), "MM"), -lookback)
    last = F.trunc(F.lit(period_to).cast("date"), "MM")
    starts = F.sequence(first, last, F.make_ym_interval(F.lit(0), F.lit(step)))
    w = spark.range(1).select(F.posexplode(starts).alias("idx", "start"))
    end = F.date_sub(F.add_months("start", step), 1)
    return w.select("idx", F.date_format("start", "yyyy-MM").alias("label"), "start", end.alias("end"), (F.col("start") < F.trunc(F.lit(period_from).cast("date"), "MM")).alias("is_history"))


def window_index(date: Column, period_from: str, lookback: int = 12, step: int = 1) -> Column:
    """The window that holds a date, by arithmetic instead of a range join."""
    first = F.add_months(F.trunc(F.lit(period_from).cast("date"), "MM"), -lookback)
    return F.floor(F.months_between(F.trunc(date, "MM"), first) / step).cast("int")


def term_presence(docs: DataFrame, period_from: str, period_to: str, lookback: int = 12, step: int = 1, earlier: bool = False) -> DataFrame:
    """(term, win, source, docs) of docs (source, timestamp, terms): documents with a term by window and source.

    A row of a term and document counts once; the shuffle carries counts, not documents. With earlier, windows before the lookback
    count too, numbered from -1 down."""
    first = F.add_months(F.trunc(F.lit(period_from).cast("date"), "MM"), -lookback)
    inside = docs.where(F.col("timestamp") < F.add_months(F.trunc(F.lit(period_to).cast("date"), "MM"), 1))
    inside = inside if earlier else inside.where(F.col("timestamp") >= first)
    rows = inside.select("source", window_index(F.col("timestamp"), period_from, lookback, step).alias("win"), F.explode(F.array_distinct("terms")).alias("term"))
    return rows.groupBy("term", "win", "source").agg(F.count("*").alias("docs"))


def term_stats(presence: DataFrame, n_history: int, n_windows: int, min_df: int = 2, mode: str = "presence") -> DataFrame:
    """One row for each term of min_df windows or more: current, mean_history, sd_history, seen, diversity, velocity series and coherence parts."""
    small_batches(presence.sparkSession)
    cell = F.lit(1) if mode == "presence" else F.col("docs")
    # dealt by term once: both groupings keep to it; a term has no more rows than windows and sources
    presence = presence.repartition("term")
    # a missing source is one of its own, which collect_set leaves out
    missing = F.array_repeat(F.lit(None).cast("string"), F.max(F.col("source").isNull().cast("int")))
    by_window = presence.groupBy("term", "win").agg(F.sum("docs").alias("docs"), F.concat(F.collect_set("source"), missing).alias("sources"))
    value = cell.cast("double")
    now, before = F.col("win") >= n_history, F.col("win") < n_history
    n_h = float(n_history)
    recent = [F.coalesce(F.sum(F.when(F.col("win") == i, value)), F.lit(0.0)) for i in range(max(n_history, n_windows - 3), n_windows)]
    stats = by_window.groupBy("term").agg(
        F.count("*").alias("n_windows"),
        F.coalesce(F.sum(F.when(now, value)), F.lit(0.0)).alias("current"),
        F.coalesce(F.sum(F.when(before, value)), F.lit(0.0)).alias("sum_h"),
        F.coalesce(F.sum(F.when(before, value * value)), F.lit(0.0)).alias("sq_h"),
        F.count_if(before).alias("seen"),
        F.array(*recent).alias("recent"),
        F.max(F.when(F.col("win") == n_windows - 1, F.col("sources"))).alias("last"),
        F.max(F.when(F.col("win") == n_windows - 2, F.col("sources"))).alias("previous"),
        F.flatten(F.collect_list("sources")).alias("_seen"),
    ).where(F.col("n_windows") >= min_df)
    # presence has one row for each term, window and source: how often a source is seen is its number of windows
    stats = stats.withColumn("diversity", S.evenness("_seen")).drop("_seen")
    mean = F.col("sum_h") / n_h
    sd = F.sqrt(F.greatest(F.col("sq_h") / n_h - mean * mean, F.lit(0.0)))
    return stats.withColumn("burst", F.greatest(F.lit(0.0), (F.col("current") - mean) / (sd + 1e-6)))


def weak_signals(stats: DataFrame, n_history: int, threshold: float | Column = 0.40, theta: float = 2.0) -> DataFrame:
    """Scored terms, kept where strength or burst passes."""
    recent = F.col("recent")
    tau = S.mann_kendall(recent)
    scored = stats.withColumn("novelty", S.novelty(F.col("seen"), F.lit(n_history)))
    scored = scored.withColumn("tau", tau).withColumn("velocity", S.velocity(recent, F.col("tau")))
    # a missing source is never new
    rising = F.size(F.array_except(F.array_compact("last"), F.coalesce("previous", F.array().cast("array<string>"))))
    coherence = F.when(F.col("previous").isNull() | F.col("last").isNull(), 0.0).otherwise(rising / F.size("last"))
    scored = scored.withColumn("coherence", coherence).withColumn("strength", S.weighted(S.STRENGTH))
    kept = scored.where((F.col("strength") >= threshold) | (F.col("burst") >= theta))
    return kept.select(S.signal_id(F.col("term")).alias("signal_id"), "term", *[F.round(c, 4).alias(c) for c in ("strength", "novelty", "coherence", "diversity", "velocity", "burst")])


def adaptive_threshold(strength: DataFrame, column: str = "strength", k: float = 1.0) -> DataFrame:
    """Mean and population deviation of past strengths, and threshold clamp(mean + k sd, 0.40, 1); 0.40 without any."""
    a = strength.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"))
    return a.select("mean", "sd", F.coalesce(S.clamp(F.col("mean") + k * F.col("sd"), 0.40, 1.0), F.lit(0.40)).alias("threshold"))


def burst_scores(counts: DataFrame, n_slots: int, recent: int = 3, threshold: float = 2.0, least: int = 3) -> DataFrame:
    """Recent against baseline means of (slot_idx, keyword, cnt); slots without a keyword count as 0."""
    n_recent = min(recent, n_slots)
    base = max(n_slots - n_recent, 1)
    g = counts.groupBy("keyword").agg(F.sum("cnt").alias("total"), F.coalesce(F.sum(F.when(F.col("slot_idx") >= n_slots - n_recent, F.col("cnt"))), F.lit(0)).alias("recent"))
    g = g.where(F.col("total") >= least)
    recent_mean, base_mean = F.col("recent") / n_recent, (F.col("total") - F.col("recent")) / base
    g = g.withColumn("ratio", recent_mean / F.greatest(base_mean, F.lit(1e-9)))
    return g.select("keyword", "total", "recent", "ratio", F.when(F.col("ratio") > 1, F.ln(1 + F.col("ratio"))).otherwise(0.0).alias("score"), (F.col("ratio") >= threshold).alias("bursting"))


def time_series(events: DataFrame, date: Column, period_from: str, period_to: str, days: int, by: list[str]) -> DataFrame:
    """Counts by window of days for each group, windows without events as 0 (N10); half-open windows."""
    start, end = F.lit(period_from).cast("date"), F.lit(period_to).cast("date")
    inside = events.where((date >= start) & (date <= end)).withColumn("win", F.floor(F.datediff(date, start) / days).cast("int"))
    counts = inside.groupBy(*by, "win").agg(F.count("*").alias("cnt"))
    groups = inside.select(*by).distinct()
    every = groups.withColumn("win", F.explode(F.sequence(F.lit(0), F.floor(F.datediff(end, start) / days).cast("int"))))
    return every.join(counts, [*by, "win"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def trend(series: DataFrame, by: list[str], rising: float = 0.6) -> DataFrame:
    """Mann-Kendall share in [0, 1], upper median of pair slopes and rising flag of each group's series.

    A group's series holds one number for each window of a period, so it is collected for each group."""
    arrays = series.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("win", "cnt"))), lambda s: s["cnt"]).alias("y"))
    n = F.size("y")
    slopes = F.flatten(F.transform("y", lambda a, i: F.transform(F.slice("y", i + 2, n), lambda b, j: (b - a) / (j + 1))))
    tau = S.mann_kendall(F.col("y"))
    out = arrays.withColumn("mk", F.when(n < 2, 0.5).otherwise((tau + 1) / 2)).withColumn("slopes", F.array_sort(slopes))
    mid = F.floor(F.size("slopes") / 2).cast("int")
    return out.select(*by, n.alias("n"), "mk", F.coalesce(F.get("slopes", mid), F.lit(0.0)).alias("slope"), ((n >= 4) & (F.col("mk") >= rising)).alias("rising"))


def spike(recent: Column, baseline: Column, multiplier: float = 1.5) -> Column:
    """Score of a rise over a baseline: 0 at the baseline, 1 from the multiplier on."""
    ratio = recent / baseline
    return F.when(baseline <= 0, F.when(recent > 0, 0.5).otherwise(0.0)).when(ratio > 1, F.least((ratio - 1) / (multiplier - 1), F.lit(1.0))).otherwise(0.0)


def burst_proxy(name: Column, tag: Column) -> Column:
    """Ten times the share of tags that contain a name, whatever the case, 1 at most; an aggregate, 0 without tags."""
    return F.least(F.coalesce(F.avg(F.contains(F.lower(tag), F.lower(name)).cast("double")), F.lit(0.0)) * 10, F.lit(1.0))


def citation_proxy(citations: Column, high: float = 50, full: int = 3) -> Column:
    """How near highly cited outputs come to a cluster of three; an aggregate."""
    return F.least(F.count_if(citations >= high) / full, F.lit(1.0))


def invest_proxy(amount: Column, full: float = 100) -> Column:
    """The sum of amounts as a share of a hundred, 1 at most; an aggregate."""
    return F.least(F.coalesce(F.sum(amount), F.lit(0.0)) / full, F.lit(1.0))


def policy_proxy(full: float = 100) -> Column:
    """The number of projects as a share of a hundred, 1 at most; an aggregate."""
    return F.least(F.count("*") / full, F.lit(1.0))


def signals_of(signals: DataFrame, least: float = 0.0, domain: str | None = None, since: str | None = None) -> DataFrame:
    """Signals of a strength, of a domain and of periods that begin on a day or later, where given."""
    kept = signals.where(F.col("strength") >= least)
    kept = kept.where(F.col("domain") == domain) if domain else kept
    return kept.where(F.col("period_from") >= F.lit(since).cast("date")) if since else kept


def discover(docs: DataFrame, period_from: str, period_to: str, n_history: int, n_windows: int, related: DataFrame, earlier: bool = False) -> tuple[DataFrame, DataFrame]:
    """(signals, edges): the weak signals of a period and the network of each with what is related to its term.

    docs and earlier as in term_presence; related has term and the lists that graph.signal_network knows, one row for each term. Signals are
    written once and read by both."""
    found = checkpointed(weak_signals(term_stats(term_presence(docs, period_from, period_to, n_history, earlier=earlier), n_history, n_windows), n_history))
    signals = found.withColumn("period_from", F.lit(period_from).cast("date")).withColumn("period_to", F.lit(period_to).cast("date"))
    return signals, graph.signal_network(found.select("signal_id", "term").join(related, "term"))


def fuse_frontier() -> Column:
    return S.weighted(S.FRONTIER)


def fuse_topic() -> Column:
    """0.6 of the strategies' and 0.4 of the reviews' weighted score (X38); columns score_* and review_*."""
    strategy = S.weighted({f"score_{k}": w for k, w in S.TOPIC_STRATEGY.items()})
    return 0.6 * strategy + 0.4 * S.weighted({f"review_{k}": w for k, w in S.TOPIC_REVIEW.items()})


def frontier_alerts(scored: DataFrame, gate: float = 0.55, alert: float = 0.80) -> DataFrame:
    """fusion, whether it is to be validated, and whether it raises an alert."""
    return scored.withColumn("validate", F.col("fusion") >= gate).withColumn("alert", F.col("fusion") >= alert)


def anomalies(df: DataFrame, fund: str, cite: str, keep: float = 0.5, flag: float = 0.7) -> DataFrame:
    """Half of fund / max and half of cite / max, kept from 0.5 on, with flags from 0.7 on."""
    top = df.agg(F.max(fund).alias("top_f"), F.max(cite).alias("top_c"))
    rank = lambda c, top: F.when(F.col(top) > 0, F.col(c) / F.col(top)).otherwise(0.0)
    x = df.join(F.broadcast(top)).withColumn("f", rank(fund, "top_f")).withColumn("c", rank(cite, "top_c"))
    x = x.withColumn("score", 0.5 * F.col("f") + 0.5 * F.col("c")).where(F.col("score") >= keep)
    flags = F.array_compact(F.array(F.when(F.col("f") >= flag, "funding"), F.when(F.col("c") >= flag, "citation")))
    return x.withColumn("flags", flags).drop("top_f", "top_c")
