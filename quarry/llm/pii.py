"""PII spans by weak-supervision aggregation, with DataFrame functions only.

Base spans of four kinds (email, ip, card, phone) come from fixed patterns and checks and always stay. The method looks
at a wider set of candidates: everything of the fixed patterns, with or without their checks, and looser forms outside
the base spans (e-mail addresses with spelled-out signs, telephone numbers without a plus, single card numbers in a longer run of
digit groups). Labelers vote on each candidate (1, 0, or -1 for
no opinion): its pattern, its check (Luhn, octets, digits), a gazetteer (top-level domains, card issuers,
area codes), context words before it, and its shape. Expectation-maximisation over the counts of vote patterns
estimates the reliability of every labeler and the share of true candidates for each kind; the posterior of each pattern is the
soft label on which the final span classifier, a logistic model on votes and surface features, is trained. Candidates
that it accepts (probability 0.5 or more) and that overlap no base span of any kind are added as spans.

Only pattern counts reach the driver: there are at most KINDS x 3^LABELERS x 2^FEATURES of them, whatever the input. Texts are read
once; their candidates are written and read again for scoring.

Work grows with a text and its n matches as n * log(n): positions, contexts and overlaps come from prefixes of arrays, and runs of
digits that are too short or too long for a card get no votes.

Offsets count code points, ends are exclusive. Defined results: a null text counts as empty; an empty or clean text has
counts of 0, the sha256 of the empty string and empty spans; repeated rows give the same spans; null doc_ids are carried; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table

KINDS = ["email", "ip", "card", "phone"]
#: Characters of the text before a candidate in which context words are looked for.
CONTEXT = 40
#: Levels that cover every text: 4^15 matches take more characters than a string has.
LEVELS = 15
#: Private-use characters that mark matches, and spaces and hyphens beside another; where a text holds them itself, they count as U+FFFD.
OPEN, CLOSE, GAP, DASH = "\uE000", "\uE001", "\uE002", "\uE003"
LOCAL = "[A-Za-z0-9._%+-]"
#: The fixed patterns, in forms that do not start within a run that an earlier start has tried.
STRICT = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9][0-9 -]*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms; what they match is a candidate and never a base span.
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}{{1,64}}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{{1,63}}+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{{2,24}}",
    "card": r"(?<![0-9]|[0-9]-)(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
}
#: Fixed values of the gazetteer and the context labeler.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "eu", "us"]
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|fon|telefon|tél|teléfono)\b",
}
LABELERS = ["pattern", "check", "gazetteer", "context", "shape"]
FEATURES = ["edge", "inner", "long"]
#: How often the check passes for true and for false candidates: known beforehand (of random numbers one in ten has a right check digit).
CHECK_PASSES = {1: 0.99, 0: 0.1}
EM_ROUNDS, FIT_ROUNDS = 50, 300


def let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefixes(xs: Column, op, levels: int = LEVELS) -> Column:
    """The array whose i-th item is op, which is associative, over the items of xs up to the i-th: of each item and those 4^k, 2 * 4^k and 3 * 4^k
    places before it, for k from 0 on, until the array is covered; with fewer levels, over the last 4^levels items."""

    def level(a: Column, k: int) -> Column:
        if k == levels:
            return a
        step = 4**k

        def upto(x: Column, i: Column, n: int) -> Column:
            return op(upto(F.get(a, i - step), i - step, n - 1), x) if n else x

        wider = F.transform(a, lambda x, i: F.when(i < step, x).when(i < 2 * step, upto(x, i, 1)).when(i < 3 * step, upto(x, i, 2)).otherwise(upto(x, i, 3)))
        return F.when(F.size(a) > step, let(wider, lambda w: level(w, k + 1))).otherwise(a)

    return let(xs, lambda a: level(a, 0))


MATCH = "struct<start:int,end:int,match:string,before:string>"


def _cut(text: Column, pattern: str) -> Column:
    """Matches of a pattern as (start, end, match, the CONTEXT characters before it), from a text without marks."""
    tail = lambda c: F.right(c, F.lit(CONTEXT))

    def of(marked: Column) -> Column:
        # the part before the first match, then each match, its mark and what follows it; every part has a character at least, so 4^3 parts have CONTEXT
        ends = prefixes(F.transform(marked, lambda x, i: F.length(x) - F.when(i > 0, 1).otherwise(0)), lambda a, b: a + b)
        tails = prefixes(F.transform(marked, lambda x: tail(F.translate(x, CLOSE, ""))), lambda a, b: tail(F.concat(a, b)), 3)

        def match(i: Column, ends: Column, tails: Column) -> Column:
            found = F.substring_index(F.get(marked, i), CLOSE, 1)
            start = F.get(ends, i - 1)
            return F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("match"), F.get(tails, i - 1).alias("before"))

        every = F.sequence(F.lit(1), F.size(marked) - 1)
        return let(ends, lambda e: let(tails, lambda t: F.transform(every, lambda i: match(i, e, t))))

    found = let(F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN), of)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{MATCH}>"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _checked(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    n = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0"), 1, 3) <= "255"))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _votes(kind: str, match: Column, before: Column, strict: bool) -> dict[str, Column]:
    """The labelers' votes as 1, 0 or -1, and the surface features as 0 or 1."""
    digits = _digits(match)
    n = F.length(digits)
    yes = lambda c: F.when(c, 1).otherwise(0)
    gazetteer = {
        "email": yes(F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1)).isin(DOMAINS)),
        "ip": F.when(match.rlike(r"^(?:10|127|172|192)\."), F.lit(1)).otherwise(F.lit(-1)),
        "card": yes(digits.rlike(ISSUERS)),
        "phone": F.when(digits.rlike(r"^1?[2-9][0-9]{2}[2-9]"), F.lit(1)).otherwise(F.lit(-1)),
    }[kind]
    shape = {
        "email": yes(match.rlike(r"^[A-Za-z0-9]") & match.rlike(r"[A-Za-z]{2,24}$")),
        "ip": yes(match.rlike(r"^[1-9]") & ~match.rlike(r"\.0[0-9]")),
        "card": yes(n.isin(15, 16) & ~match.rlike(r"[ -][0-9]{1,2}[ -]")),
        "phone": yes(n.between(10, 13) & match.rlike(r"[ ().-]")),
    }[kind]
    return {
        "pattern": F.lit(1 if strict else -1),
        "check": yes(_checked(kind, match)) if kind != "email" else F.lit(1 if strict else -1),
        "gazetteer": gazetteer,
        "context": F.when(before.rlike(CUES[kind]), F.lit(1)).otherwise(F.lit(-1)),
        "shape": shape,
        "edge": yes(before.rlike(r"[\s:(<]$") | (before == "")),
        "inner": yes(match.rlike(r"[ ().-]")),
        "long": yes(F.length(match) > 16),
    }


def _candidate(i: int, kind: str, strict: bool):
    def made(s: Column) -> Column:
        base = _checked(kind, s["match"]) if strict else F.lit(False)
        votes = _votes(kind, s["match"], F.translate(s["before"], GAP + DASH, " -"), strict)
        return F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), *(v.cast("int").alias(n) for n, v in votes.items()))

    return made


def _is_kind(i: int):
    return lambda c: c["kind"] == i


CANDIDATE = "struct<kind:int,start:int,end:int,base:boolean," + ",".join(f"{n}:int" for n in (*LABELERS, *FEATURES)) + ">"


def _with_free(cands: Column) -> Column:
    """cands with free: whether a candidate overlaps no base span.

    Base spans in order of their starts meet the others in order of their ends: the greatest end so far tells."""
    events = F.array_sort(F.transform(cands, lambda c: F.struct(F.when(c["base"], c["start"]).otherwise(c["end"]).alias("at"), c["base"].alias("base"), c.alias("c"))))

    def flagged(e: Column) -> Column:
        far = prefixes(F.transform(e, lambda x: F.when(x["base"], x["c"]["end"]).otherwise(0)), F.greatest)
        return let(far, lambda m: F.transform(e, lambda x, i: F.struct(x["c"].alias("c"), (x["base"] | (F.get(m, i) <= x["c"]["start"])).alias("free"))))

    return F.when(F.size(cands) > 0, let(events, flagged)).otherwise(F.array().cast(f"array<struct<c:{CANDIDATE},free:boolean>>"))


def candidates(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text): doc_id and cands, an array of structs of kind (its place in KINDS), start, end, base, all votes and features, and free."""
    clean = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE + GAP + DASH, "�" * 4)
    # two separators in a row end a card number: each of them becomes a mark of the same length
    parted = F.regexp_replace(F.regexp_replace("clean", r"(?<=[ -]) | (?=[ -])", GAP), rf"(?<=[ {GAP}-])-|-(?=[ {GAP}-])", DASH)
    texts = docs.select("doc_id", clean.alias("clean")).withColumn("parted", parted)
    columns = []
    for i, kind in enumerate(KINDS):
        texts = texts.withColumn(f"strict_{kind}", _cut(F.col("parted" if kind == "card" else "clean"), STRICT[kind]))
        columns.append((i, kind, f"strict_{kind}", True))
        if kind in LOOSE:
            texts = texts.withColumn(f"loose_{kind}", _cut(F.col("clean"), LOOSE[kind]))
            columns.append((i, kind, f"loose_{kind}", False))
    # runs of digits that cannot be card numbers are no candidates
    texts = texts.withColumn("strict_card", F.filter("strict_card", lambda s: F.length(_digits(s["match"])).between(12, 19)))
    lists = [F.transform(column, _candidate(i, kind, strict)) for i, kind, column, strict in columns]
    texts = texts.select("doc_id", F.concat(*lists).alias("found"))
    # what lies in a base span is no candidate of its own, unless the fixed pattern found it
    kept = F.filter(_with_free(F.col("found")), lambda x: x["free"] | (x["c"]["pattern"] == 1))
    return texts.select("doc_id", F.transform(kept, lambda x: x["c"].withField("free", x["free"])).alias("cands"))


def estimate(patterns: list[tuple[int, tuple[int, ...], float]]) -> tuple[list[float], dict[tuple[int, tuple[int, ...]], float]]:
    """EM over (kind, votes, count): the share of true candidates of each kind, and the posterior of each (kind, votes).

    Labelers are independent given the truth; each has its own rates for each kind, with a prior that votes are better than chance.
    Only the check's rates are given, not estimated."""
    posterior = {(k, v): sum(x == 1 for x in v) / max(1, sum(x >= 0 for x in v)) for k, v, _ in patterns}
    share = [0.5] * len(KINDS)
    for _ in range(EM_ROUNDS):
        rate: dict[tuple[int, int, int], float] = {}
        for k in range(len(KINDS)):
            own = [(v, n, posterior[k, v]) for kk, v, n in patterns if kk == k]
            if not own:
                continue
            share[k] = (sum(n * p for _, n, p in own) + 1) / (sum(n for _, n, _ in own) + 2)
            for j in range(len(LABELERS)):
                for truth in (0, 1):
                    seen = [(v[j], n * (p if truth else 1 - p)) for v, n, p in own if v[j] >= 0]
                    # pseudo-counts of ten candidates: 70 % of the votes are right
                    rate[k, j, truth] = (sum(n for x, n in seen if x == 1) + (7 if truth else 3)) / (sum(n for _, n in seen) + 10)
                    if LABELERS[j] == "check":
                        rate[k, j, truth] = CHECK_PASSES[truth]
        for k, v, _ in patterns:
            logs = []
            for truth in (0, 1):
                total = math.log(share[k] if truth else 1 - share[k])
                for j, x in enumerate(v):
                    if x >= 0:
                        total += math.log(rate[k, j, truth] if x == 1 else 1 - rate[k, j, truth])
                logs.append(total)
            posterior[k, v] = 1 / (1 + math.exp(min(700.0, logs[0] - logs[1])))
    return share, posterior


def inputs(kind: int, votes: tuple[int, ...], features: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == 1) - float(v == 0) for v in votes), *map(float, features)]


def fit_classifier(rows: list[tuple[list[float], float, float]]) -> list[float]:
    """Weights of a logistic model fitted on (inputs, soft label, count) by gradient descent."""
    width = 1 + len(KINDS) + len(LABELERS) + len(FEATURES)
    w = [0.0] * width
    total = sum(n for *_, n in rows)
    if not total:
        return [-1.0] + [0.0] * (width - 1)
    for _ in range(FIT_ROUNDS):
        g = [0.01 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, a in enumerate(x):
                if a:
                    g[i] += n / total * (p - y) * a
        w = [a - 0.5 * b for a, b in zip(w, g, strict=True)]
    return w


def train(cands: DataFrame) -> list[float]:
    """Weights of the span classifier, from the counts of all vote and feature patterns."""
    each = cands.select(F.explode("cands").alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in ("kind", *LABELERS, *FEATURES)]).count()
    rows = [(r["kind"], tuple(r[n] for n in LABELERS), tuple(r[n] for n in FEATURES), float(r["count"])) for r in each.collect()]
    rows.sort()
    votes: dict[tuple[int, tuple[int, ...]], float] = {}
    for k, v, _, n in rows:
        votes[k, v] = votes.get((k, v), 0.0) + n
    _, posterior = estimate([(k, v, n) for (k, v), n in sorted(votes.items())])
    return fit_classifier([(inputs(k, v, f), posterior[k, v], n) for k, v, f, n in rows])


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"], c["kind"], c["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added of each row of docs (doc_id, text)."""
    cands = materialize(candidates(docs), "pii-cands")
    weights = train(cands)
    first, by_kind = weights[0], weights[1 : 1 + len(KINDS)]
    rest = dict(zip((*LABELERS, *FEATURES), weights[1 + len(KINDS) :], strict=True))

    def accepted(c: Column) -> Column:
        z = F.lit(first) + F.get(F.array(*map(F.lit, by_kind)), c["kind"])
        for n in LABELERS:
            z = z + F.lit(rest[n]) * F.when(c[n] == 1, 1.0).when(c[n] == 0, -1.0).otherwise(0.0)
        for n in FEATURES:
            z = z + F.lit(rest[n]) * c[n]
        return z >= 0

    split = cands.select("doc_id", F.filter("cands", lambda c: c["base"]).alias("base"), F.filter("cands", lambda c: ~c["base"]).alias("other"))
    split = split.withColumn("added", F.filter("other", lambda c: c["free"] & accepted(c)))
    # of added spans that hang together by overlaps, the earliest and then the longest stays
    ordered = F.array_sort(F.transform("added", lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("kind"))))

    def heads(o: Column) -> Column:
        far = prefixes(F.transform(o, lambda c: -c["back"]), F.greatest)
        chosen = let(far, lambda m: F.filter(o, lambda c, i: (i == 0) | (F.get(m, i - 1) <= c["start"])))
        return F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["back"]).alias("end")))

    split = split.withColumn("kept", let(ordered, heads))
    slim = F.transform("base", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return split.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat(slim, F.col("kept"))).alias("spans"), F.size("kept").cast("long").alias("n_added"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
