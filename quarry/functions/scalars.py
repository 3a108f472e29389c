"""Scalar functions as Column expressions: text, dates, arrays, identity and scores (X1-X45 of the survey, N2-N4, N15)."""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- text ---


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no such function."""
    return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def strip(c: Column) -> Column:
    """Trim all Unicode white space, as trim() takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_org_name(c: Column) -> Column:
    return F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")


normalize_person_name = normalize_org_name

#: Suffixes of organisation names, in order of preference.
ORG_SUFFIXES = [
    "股份有限公司", "有限责任公司", "有限公司", "责任有限公司", "集团有限公司", "控股有限公司", "投资有限公司", "科技有限公司",
    "集团公司", "研究院", "研究所", "实验室", "研发中心", "技术中心", "工程中心", "大学",
]


def strip_org_suffix(c: Column, suffixes: list[str] = ORG_SUFFIXES) -> Column:
    return F.regexp_replace(c, f"(?:{'|'.join(suffixes)})$", "")


def clean_text(c: Column) -> Column:
    """NFKC, without control characters, runs of white space as one space, trimmed."""
    dropped = F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return strip(F.regexp_replace(dropped, r"(?U)\s+", " "))


def truncate_text(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def title_key(c: Column) -> Column:
    """Title lower-cased, punctuation as single spaces, trimmed (apply nfkc before for full-width forms)."""
    spaced = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]+", " ")
    return strip(F.regexp_replace(spaced, r"(?U)\s+", " "))


def title_fingerprint(c: Column) -> Column:
    return F.md5(title_key(c).cast("binary"))


#: Aliases of technical terms.
TERM_ALIASES = {
    "质谱仪": "质谱仪", "质谱": "质谱仪", "mass spectrometry": "质谱仪", "mass spectrometer": "质谱仪", "ms": "质谱仪",
    "液相色谱": "液相色谱", "high performance liquid chromatography": "液相色谱", "hplc": "液相色谱",
    "量子计算": "量子计算", "quantum computing": "量子计算",
}


def normalize_term(c: Column, aliases: dict[str, str] = TERM_ALIASES) -> Column:
    lowered = F.lower(strip(c))
    plain = F.regexp_replace(lowered, r"(?U)[。，,;；:：.、()【】\[\]\"'!?！？\s]+", "")
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(known, lowered), plain)


def split_list(c: Column, separators: str = r"[;｜|,，]") -> Column:
    """Parts between separators, trimmed, without blanks (X8; with `；` and line breaks X9; with `[;，,]` X10)."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separators), strip)
    return F.filter(parts, lambda x: x != "")


def name_list(c: Column) -> Column:
    """Names of a JSON array, or split at ; and , (X11)."""
    return F.coalesce(F.from_json(c, "array<string>"), split_list(c, "[;,；，]"))


def has_cjk(c: Column) -> Column:
    return c.rlike("[一-鿿]")


def detect_lang(c: Column) -> Column:
    return F.when(has_cjk(c), "zh").otherwise("en")


def tokenize(c: Column, stop_words: list[str] = ()) -> Column:
    """Words of two or more letters, lower-cased; for CJK text runs of ideographs or letters."""
    words = F.when(has_cjk(c), F.regexp_extract_all(c, F.lit("([一-鿿]{2,}|[A-Za-z]+)"), F.lit(1))).otherwise(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    words = F.filter(words, lambda w: F.length(w) > 1)
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


#: Fixed patterns of identifiers in text.
IDENTIFIERS = {
    "cn_patent": r"(?i)(CN\d{9,12}[A-Z]?(?:\.\d)?)",
    "wo_patent": r"(?i)(WO\d{4}/\d{6,8})",
    "ipc": r"(?i)([A-H]\d{2}[A-Z]\s*\d+/\d+)",
    "grant_no": r"(\d{8})",
    "doi": r"(10\.\d{4,9}/\S+)",
    "email": r"(?U)([\w.+-]+@[\w-]+\.[a-zA-Z]{2,})",
    "url": r"(https?://\S+)",
}


def identifier(c: Column, kind: str) -> Column:
    found = F.regexp_extract(c, IDENTIFIERS[kind], 1)
    return F.when(found != "", found)


def ipc_subclass(c: Column) -> Column:
    found = F.regexp_extract(F.upper(strip(c)), r"^([A-H]\d{2}[A-Z])", 1)
    return F.when(found != "", found)


def ipc_section(c: Column) -> Column:
    return F.substring(ipc_subclass(c), 1, 1)


#: Part of a degree's text and the degree, the first that fits counts.
DEGREES = [("博士", "博士"), ("硕士", "硕士"), ("本科", "本科"), ("学士", "本科")]


def degree(c: Column) -> Column:
    return reduce(lambda rest, d: F.when(c.contains(d[0]), d[1]).otherwise(rest), reversed(DEGREES), F.lit(None).cast("string"))


def context(text: Column, start: Column, end: Column, around: int = 500, cap: int = 2000) -> Column:
    """The text around a span, start and end in code points from 0, cut at cap with an ellipsis."""
    a = F.greatest(start - around, F.lit(0))
    return truncate_text(F.substring(text, a + 1, end + around - a), cap)


# --- identity ---


def stable_id(kind: str, *parts: Column) -> Column:
    joined = F.concat_ws("::", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{kind}_S_"), F.substring(F.sha2(joined, 256), 1, 16))


STRONG_KEYS = ["company_id", "usc_code", "orcid", "patent_number", "doi", "email"]


def entity_id(keys: dict[str, Column], name: Column) -> Column:
    """The first strong key present, else a name id, else null (the record is rejected)."""
    strong = [F.when(F.length(strip(keys[k].cast("string"))) > 0, keys[k].cast("string")) for k in STRONG_KEYS if k in keys]
    return F.coalesce(*strong, name_id(name))


def name_id(name: Column) -> Column:
    plain = strip(name)
    short = F.regexp_replace(plain, r"(?U)[^\w-]", "_")
    long = F.concat(F.regexp_replace(F.substring(plain, 1, 42), r"(?U)[^\w-]", "_"), F.lit("_"), F.substring(F.md5(plain.cast("binary")), 1, 15))
    return F.when(F.length(plain) > 0, F.concat(F.lit("name:"), F.when(F.length(plain) > 58, long).otherwise(short)))


def signal_id(term: Column) -> Column:
    return F.concat(F.lit("WS-"), F.substring(F.md5(term.cast("binary")), 1, 16))


def concept_id(term: Column) -> Column:
    return F.concat(F.lit("concept:"), F.substring(F.md5(term.cast("binary")), 1, 12))


# --- dates ---

#: Date formats in the order they are tried.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "yyyy年M月d日", "yyyy.M.d", "yyyyMMdd", "yyyy-M", "yyyy/M", "yyyy年M月", "yyyy"]


def normalize_date(c: Column) -> Column:
    plain = F.regexp_replace(c, r"(?U)\s+", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)).cast("date") for f in DATE_FORMATS])


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


# --- values, arrays, JSON ---


def has_value(c: Column, kind: str = "string") -> Column:
    """Not null, not blank, not empty."""
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(strip(c) != "", F.lit(False)) if kind == "string" else c.isNotNull()


def one(c: Column) -> Column:
    return F.when(has_value(c), F.array(c)).otherwise(F.array().cast("array<string>"))


def head(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def fenced_json(c: Column) -> Column:
    """JSON text within a model's answer: inside code fences, else from the first { to the last }."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(fence != "", strip(fence)).when(braces != "", braces)


def feature(features: Column, name: str) -> Column:
    """A value of a JSON object column; bad JSON gives null."""
    return F.get_json_object(features, f"$.{name}")


def char_jaccard(a: Column, b: Column) -> Column:
    return jaccard_of(*(F.array_distinct(F.split(s, "")) for s in (a, b)))


def jaccard_of(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays without repeats."""
    common = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - common
    return F.when(union == 0, 0.0).otherwise(common / union)


# --- scores ---


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def weighted(parts: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in parts.items()])


#: Fixed weights of the composed scores.
STRENGTH = {"novelty": 0.30, "coherence": 0.25, "diversity": 0.20, "velocity": 0.25}
FRONTIER = {"burst": 0.20, "patent": 0.25, "citation": 0.20, "invest": 0.20, "policy": 0.15}
TOPIC_STRATEGY = {"hot": 0.25, "policy": 0.20, "impact": 0.20, "dedup": 0.15, "llm_gen": 0.20}
TOPIC_REVIEW = {"novelty": 0.30, "importance": 0.30, "feasibility": 0.20, "expression": 0.20}
QUALITY = {"completeness": 0.4, "veracity": 0.3, "timeliness": 0.3}


def timeliness(date: Column, today: Column, half_life: int = 180) -> Column:
    age = F.greatest(F.datediff(today, date), F.lit(0))
    return F.when(date.isNull(), 0.0).otherwise(F.exp(-age * F.lit(0.6931471805599453) / half_life))


def authority_bonus(*present: Column) -> Column:
    return F.least(F.lit(0.15), F.lit(0.05) * reduce(lambda a, b: a + b, [p.cast("int") for p in present]))


def consistency(invented: Column, applied: Column) -> Column:
    return F.when(invented > applied, 0.85).otherwise(1.0)


#: Fixed values of source trust, and parts of a table's name that mark user-made content.
TRUST = {"ods": 0.90, "llm": 0.70, "import": 0.60, "ugc": 0.40, "unknown": 0.50}
UGC_HINTS = ["web", "crawl", "ugc"]


def source_trust(table: Column, channel: Column) -> Column:
    t, c = F.lower(F.coalesce(table, F.lit(""))), F.lower(F.coalesce(channel, F.lit("")))
    low = F.when(c.isin("llm", "enrich"), TRUST["llm"]).when(c.isin("import", "bulk"), TRUST["import"]).otherwise(TRUST["unknown"])
    return F.when(t.startswith("ods_"), TRUST["ods"]).when(t.rlike("|".join(UGC_HINTS)), TRUST["ugc"]).otherwise(low)


def credibility(trust: Column, bonus: Column, factor: Column) -> Column:
    return clamp((trust + bonus) * factor)


def completeness(required: list[Column], recommended: list[Column]) -> Column:
    """Weighted share of present fields: required count 1, recommended 0.5; without any field 1."""
    total = len(required) + 0.5 * len(recommended)
    if not total:
        return F.lit(1.0)
    got = reduce(lambda a, b: a + b, [p.cast("double") for p in required] + [0.5 * p.cast("double") for p in recommended])
    return F.round(got / total, 4)


def band(score: Column, auto: float = 0.95, judge: float = 0.70) -> Column:
    return F.when(score >= auto, "auto").when(score >= judge, "judge").otherwise("discard")


def burst_zscore(x: Column, history: Column, eps: float = 1e-6) -> Column:
    """max(0, (x - mean) / (population deviation + eps)) over an array; 0 without history."""
    h = F.transform(history, lambda v: v.cast("double"))
    n = F.size(h)
    mean = F.aggregate(h, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(h, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (x - mean) / (F.sqrt(var) + eps)))


@F.arrow_udf(T.DoubleType())
def evenness(labels: pa.Array) -> pa.Array:
    """Entropy of an array's labels, null being one, by that of as many equally frequent ones, 0 for one label or none; rare labels are added first.

    Spark's ln(3) is one unit in the last place less than the C library's, which scores at a threshold show; so logarithms are Python's."""
    rows, codes = len(labels), labels.flatten().dictionary_encode("encode")
    n = max(1, len(codes.dictionary))
    cells, counts = np.unique(np.repeat(np.arange(rows), labels.value_lengths().fill_null(0).to_numpy()) * n + codes.indices.to_numpy(), return_counts=True)
    order = np.lexsort((counts, cells // n))
    row, counts = (cells // n)[order], counts[order]
    p = counts / np.bincount(row, counts, rows)[row]
    different, place = np.unique(p, return_inverse=True)
    entropy = -np.bincount(row, p * np.array([math.log(x) for x in different.tolist()])[place], rows)
    kinds = np.bincount(row, minlength=rows)
    most = np.array([math.log(max(k, 2)) for k in range(int(kinds.max(initial=0)) + 1)])[kinds]
    return pa.array(np.where(kinds > 1, entropy / most, 0.0))


def novelty(seen: Column, total: Column) -> Column:
    return F.when(total <= 0, 1.0).otherwise(1 - clamp(seen / total))


def mann_kendall(series: Column) -> Column:
    """tau of an array: pairs that rise less those that fall, over all pairs; 0 below two points."""
    n = F.size(series)
    signs = F.transform(series, lambda x, i: F.aggregate(F.slice(series, i + 2, n), F.lit(0.0), lambda a, y: a + F.signum(y.cast("double") - x.cast("double"))))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(signs, F.lit(0.0), lambda a, s: a + s) / (n * (n - 1) / 2))


def slope(series: Column) -> Column:
    """Ordinary least squares slope of an array over 0, 1, 2, ...; 0 below two points."""
    n = F.size(series)
    mean_t = (n - 1) / 2
    sxy = F.aggregate(F.transform(series, lambda y, t: (t - mean_t) * y.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return F.when(n < 2, 0.0).otherwise(sxy / ((n * (n * n - 1)) / 12))


def velocity(series: Column, tau: Column, least_tau: float = 0.6) -> Column:
    top = F.array_max(series).cast("double")
    v = F.when((F.size(series) < 2) | (top <= 0), 0.0).otherwise(clamp(slope(series) / top))
    return F.when(tau < least_tau, v * 0.5).otherwise(v)
