"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule fits its host and all subdomains of it, and URLs whose path starts with the rule's; the longest rule wins. URLs
that a rule decides are the labelled ones (a labelled table may be given instead): from them, gradient-boosted trees of
depth TREE_DEPTH are trained with logistic loss on lexical features of a URL: its length, path depth, digit ratio, entropy
of characters, number of query parameters, hyphens, longest label, and suffix statistics: the smoothed share of blocked
URLs among the labelled ones of the same host suffix (last two labels) and of the same first path segment.

Suffix statistics are counted in Spark over all labelled URLs and joined to the pages by suffix and by segment. For training
they are out of fold: a URL's statistics leave out the FOLD of it. A suffix that no labelled URL has gets the overall
share, and so do, in training, the statistics of one URL in HIDDEN, so that trees learn what to say then. Scores of URLs
of such suffixes are calibrated (a slope and an offset of the log odds) on labelled URLs scored by trees that have
seen no URL of their suffix; where all labelled URLs have one suffix, they are shrunk to the overall share.

Bounds: trees are fitted on TRAIN_URLS labelled URLs at most, those with the smallest hash of the URL.

Defined results: null URLs and those without `://` have an empty host and path and fit no rule; they are scored like
others. Without labelled URLs, or with labels of one kind only, the verdict is that kind's, else allow. Repeated rows
are judged alike; an empty table gives an empty result; other columns are carried along and those with the names of
the results replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, discard, free_name, lower_ascii, materialize, table

#: Host, path and verdict of each rule.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
TRAIN_URLS = 20_000
#: Folds of labelled URLs, of suffixes for the calibration, and URLs of which one has hidden statistics in training.
FOLDS, SUFFIX_FOLDS, HIDDEN = 5, 4, 3
#: Labelled URLs of the overall share that are added to each suffix.
SMOOTH = 10.0
#: Least slope of the calibration, so that URLs of suffixes without a label keep their order.
LEAST_SLOPE = 0.25
#: Rows of suffix statistics up to which they are broadcast; larger tables are shuffled.
BROADCAST_ROWS = 500_000
TREES, TREE_DEPTH, BINS, RATE = 40, 3, 32, 0.2


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, lower-cased; then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


@dataclass
class Trees:
    """Boosted trees: each level of a tree asks one feature per node; scores are log odds of block."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)]) if self.edges else np.zeros(x.shape, int)

    def score(self, x: np.ndarray) -> np.ndarray:
        out, bins = np.full(len(x), self.base), self.binned(x)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(TREE_DEPTH):
                at = 2 * at + 1 + (bins[np.arange(len(x)), feature[at]] > cut[at])
            out += leaf[at - (2**TREE_DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Histogram gradient boosting with logistic loss; y is 1 for block."""
    if not len(y):
        return Trees(base=-1.0)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Trees(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    bins, score = model.binned(x), np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**TREE_DEPTH - 1, int), np.full(2**TREE_DEPTH - 1, BINS)
        at = np.zeros(len(y), dtype=int)
        for depth in range(TREE_DEPTH):
            for node in range(2**depth - 1, 2 ** (depth + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 20:
                    continue
                best = (1e-6, 0, BINS)
                for i in range(bins.shape[1]):
                    gs = np.cumsum(np.bincount(bins[rows, i], g[rows], BINS + 1))
                    hs = np.cumsum(np.bincount(bins[rows, i], h[rows], BINS + 1))
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    j = int(gain[:-1].argmax())
                    best = max(best, (float(gain[j]), -i, -j)) if gain[j] > best[0] else best
                if best[0] > 1e-6:
                    feature[node], cut[node] = -best[1], -best[2]
            at = 2 * at + 1 + (bins[np.arange(len(y)), feature[at]] > cut[at])
        leaves = at - (2**TREE_DEPTH - 1)
        n = 2**TREE_DEPTH
        leaf = -RATE * np.bincount(leaves, g, n) / (np.bincount(leaves, h, n) + 1)
        model.trees.append((feature, cut, leaf))
        score += leaf[leaves]
    return model


def lexical_features(url: pd.Series, host: pd.Series, path: pd.Series) -> np.ndarray:
    """Ten columns, counted over the code points of all the URLs at once."""

    def points(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        encoded = [t.encode("utf-32-le", "surrogatepass") for t in column.fillna("")]
        sizes = np.array([len(e) // 4 for e in encoded], dtype=np.int64)
        return np.frombuffer(b"".join(encoded), np.uint32), np.repeat(np.arange(len(encoded)), sizes), sizes

    n = len(url)
    chars, row, size = points(url)
    count = lambda hit, rows=row: np.bincount(rows[hit], minlength=n).astype(float)
    each, times = np.unique((row.astype(np.uint64) << np.uint64(32)) | chars, return_counts=True)
    owner = (each >> np.uint64(32)).astype(np.int64)
    share = times / np.maximum(size, 1)[owner]
    entropy = np.bincount(owner, -share * np.log2(share), n)
    query = url.fillna("").str.partition("?")[2].str.partition("#")[0] if n else url
    q_chars, q_row, _ = points(query)
    h_chars, h_row, h_size = points(host)
    p_chars, p_row, _ = points(path)
    longest = np.array([max(map(len, h.split("."))) for h in host], dtype=float) if n else np.zeros(0)
    digits = count((chars >= 48) & (chars <= 57)) / np.maximum(size, 1)
    parameters = count((q_chars == 61) | (q_chars == 38), q_row)
    secure = url.fillna("").str.startswith("https").to_numpy(float) if n else np.zeros(0)
    return np.column_stack([size, h_size, count(p_chars == 47, p_row), digits, entropy, parameters, count(chars == 45), 1 + count(h_chars == 46, h_row), longest, secure]).astype(float)


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def segment(path: Column) -> Column:
    """What stands between a path's first two slashes."""
    return F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))


@dataclass
class Model:
    trees: Trees
    overall: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def block_score(self, lexical: np.ndarray, stats: np.ndarray, unseen: np.ndarray) -> np.ndarray:
        """Probability of block from features and statistics (suffix, segment; nan for the overall share)."""
        z = self.trees.score(np.column_stack([lexical, np.where(np.isnan(stats), self.overall, stats)]))
        z = np.where(unseen, self.slope * z + self.offset, z)
        return _share(z)


def _share(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(z: np.ndarray, y: np.ndarray, suffixes: int) -> tuple[float, float]:
    """Slope (LEAST_SLOPE at least) and offset of log odds, fitted with smoothed targets; the fewer suffixes there are to judge by,
    the more the slope is held to a half."""
    pull = 1.0 / suffixes
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 0.5, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(300):  # one after the other, so that the offset follows a slope at its bound
        p = _share(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        a = max(LEAST_SLOPE, a - np.clip((((p - target) * z).mean() + pull * (a - 0.5)) / ((w * z * z).mean() + pull), -1, 1))
        p = _share(a * z + b)
        b -= np.clip((p - target).mean() / np.maximum(p * (1 - p), 1e-6).mean(), -1, 1)
    return float(a), float(b)


def fit(rows: pd.DataFrame, overall: float) -> Model:
    """A model from labelled URLs: url, host, path, blocked, suffix, suffix_share and segment_share (out of fold), hide."""
    y = rows["blocked"].to_numpy(float)
    lexical = lexical_features(rows["url"], rows["host"], rows["path"])
    stats = rows[["suffix_share", "segment_share"]].to_numpy(float)
    hidden = np.where(rows["hide"].to_numpy(bool)[:, None], overall, np.where(np.isnan(stats), overall, stats))
    model = Model(fit_trees(np.column_stack([lexical, hidden]), y), overall)
    if not len(y) or y.min() == y.max():
        return model
    codes, suffixes = pd.factorize(rows["suffix"], sort=True)
    groups = codes % SUFFIX_FOLDS
    z = np.full(len(y), np.nan)
    for g in np.unique(groups) if len(suffixes) > 1 else ():
        out = groups == g
        trees = fit_trees(np.column_stack([lexical, hidden])[~out], y[~out])
        z[out] = trees.score(np.column_stack([lexical[out], np.full(out.sum(), overall), np.where(np.isnan(stats[out, 1]), overall, stats[out, 1])]))
    share = min(max(overall, 1e-3), 1 - 1e-3)
    model.slope, model.offset = calibrate(z, y, len(suffixes)) if len(suffixes) > 1 else (0.5, 0.5 * float(np.log(share / (1 - share))))
    return model


@dataclass
class Trained:
    """A model with the tables of its statistics: of all labelled URLs, the smoothed share of blocked ones by suffix and by segment."""

    model: Model
    suffixes: DataFrame
    segments: DataFrame


def _shares(labelled: DataFrame, key: str, overall: float) -> DataFrame:
    """key, share, and by_fold: the share without the URLs of each fold."""
    by_fold = labelled.groupBy(key, "fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    total = by_fold.groupBy(key).agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "b")))).alias("own"))
    share = lambda n, b: (b + SMOOTH * overall) / (n + SMOOTH)
    part = lambda fold, c: F.coalesce(F.col("own")[F.lit(fold)][c], F.lit(0))
    folds = F.array(*(F.when(F.col("n") > part(f, "n"), share(F.col("n") - part(f, "n"), F.col("b") - part(f, "b"))) for f in range(FOLDS)))
    return total.select(key, share(F.col("n"), F.col("b")).alias("share"), folds.alias("by_fold"))


def train(labelled: DataFrame, limit: int = TRAIN_URLS) -> Trained:
    """A model from labelled URLs (url, host, path, verdict)."""
    known = labelled.where("url is not null and verdict is not null").select("url", "host", "path", "verdict").distinct()
    known = known.select("url", "host", "path", F.when(F.col("verdict") == "block", 1.0).otherwise(0.0).alias("blocked"), suffix(F.col("host")).alias("suffix"), segment(F.col("path")).alias("segment"), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int").alias("fold"))
    known = materialize(known, "url-labelled")
    overall = float(known.agg(F.avg("blocked")).first()[0] or 0.0)
    suffixes, segments = (materialize(_shares(known, key, overall), f"url-{key}") for key in ("suffix", "segment"))
    sample = known.orderBy(F.xxhash64("url"), "url").limit(limit)
    for table_, key in ((suffixes, "suffix"), (segments, "segment")):
        sample = sample.join(table_.select(key, F.col("by_fold").alias(f"{key}_folds")), key, "left").withColumn(f"{key}_share", F.get(f"{key}_folds", F.col("fold"))).drop(f"{key}_folds")
    rows = sample.withColumn("hide", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(HIDDEN)) == 0).drop("segment", "fold").toPandas().sort_values("url", kind="stable", ignore_index=True)
    discard(known)
    return Trained(fit(rows, overall), suffixes.drop("by_fold"), segments.drop("by_fold"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, trained: Trained | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and block_score (the trees' probability of block)."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    host, path = url_parts(F.col("url"))
    parted = pages.select(*own, host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parted.withColumn("rule", rule).withColumn("verdict", verdict)
    trained = trained or train(ruled)
    shared = pages.sparkSession.sparkContext.broadcast(trained.model)
    of_suffix, of_segment = (free_name(c, ruled.columns) for c in ("suffix_share", "segment_share"))
    for stats, key, of, name in ((trained.suffixes, suffix(F.col("host")), "suffix", of_suffix), (trained.segments, segment(F.col("path")), "segment", of_segment)):
        known = free_name(f"known_{of}", ruled.columns)
        small = stats.select(F.col(of).alias(known), F.col("share").alias(name))
        ruled = ruled.join(broadcast_if_small(small, stats.count(), BROADCAST_ROWS), key == F.col(known), "left").drop(known)

    @F.pandas_udf("double")
    def block_score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = shared.value
        for url, h, p, a, b in batches:
            stats = np.column_stack([a.to_numpy(float), b.to_numpy(float)])
            yield pd.Series(m.block_score(lexical_features(url, h, p), stats, np.isnan(stats[:, 0])), dtype=float)

    scored = ruled.withColumn("block_score", block_score("url", "host", "path", of_suffix, of_segment))
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))).drop(of_suffix, of_segment)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
