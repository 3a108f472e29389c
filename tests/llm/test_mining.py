"""Collocations, whitening and secrets against brute force, on small fixtures with nulls, repeats, long and empty texts."""

import hashlib
import random
import re
import string
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import collocations, secret_scan, whitening

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdeé", k=RNG.randint(1, 4))) for _ in range(40)]


# --- op11 ---


def pieces_of(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def collocations_by_hand(rows, best, least=10, most=3):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for k in range(1, most + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(la == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (la, q), b in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:best])]
    return sorted(ranked)


def mined(spark, rows, **options):
    found = collocations.mine(spark.createDataFrame(rows, "lang string, text string"), **options).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found)


def phrase_rows():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = rng.choices(WORDS, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text.title() if i % 7 == 0 else text))
    rows += rows[:20] + [(None, None), ("en", None), ("fr", ""), ("en", " \t. ,"), ("en", "same " * 3000), ("de", "x" * 100_000 + " b" * 12), ("it", "up the hill. up the hill")]
    return rows


def test_collocations(spark):
    rows = phrase_rows()
    assert mined(spark, rows) == collocations_by_hand(rows, 2000)
    assert mined(spark, rows, best=5, least=3) == collocations_by_hand(rows, 5, 3)


def test_collocations_of_four_words(spark, monkeypatch):
    rows = phrase_rows()
    monkeypatch.setattr(collocations, "BROADCAST_PHRASES", 0)
    want = collocations_by_hand(rows, 2000, 4, 4)
    assert any(len(r[2].split(" ")) == 4 for r in want)
    assert mined(spark, rows, least=4, most_words=4) == want


def test_collocations_do_not_depend_on_shards(spark, monkeypatch):
    """Shards of a few words, groups of a few entries, merges of a few counts and a filter that is full: the same counts."""
    rows = phrase_rows()
    whole = mined(spark, rows)
    for name, value in (("SHARD_WORDS", 50), ("GROUP", 7), ("MERGED", 100), ("BLOCKS", 3), ("MOST_FILTER_BITS", 64)):
        monkeypatch.setattr(collocations, name, value)

    batch = pa.RecordBatch.from_pylist([{"lang": la or "und", "text": t or ""} for la, t in rows], schema=pa.schema([("lang", pa.string()), ("text", pa.string())]))
    shards = list(collocations._vertical(iter([batch.slice(i, 3) for i in range(0, len(rows), 3)])))
    assert len(shards) > 20
    every = collocations.Filter(np.full(1, ~np.uint64(0)))
    counts = Counter()
    for lang, words, entries in collocations._shards_of(iter(shards)):
        for ids, n in collocations.level_counts(collocations.word_hashes(lang, words), entries, 3, [every] * 2):
            for p, c in zip(collocations._names(words, ids).to_pylist(), n.tolist(), strict=True):
                counts[lang, p] += c
    plain = Counter()
    for la, t in rows:
        for w in pieces_of(t):
            plain.update((la or "und", " ".join(w[i : i + 3])) for i in range(len(w) - 2))
    assert counts == plain
    assert whole == collocations_by_hand(rows, 2000)


def test_collocations_odd_tables(spark):
    assert mined(spark, [(None, None)]) == []
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).count() == 0
    clashing = spark.createDataFrame([("en", "a b " * 12, "x", 1, "y")], "lang string, text string, phrase string, n long, words string")
    assert collocations.mine(clashing).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_wide_products(spark):
    """Scores of counts whose products pass 64 bits."""
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    found = spark.range(1).select(*(F.lit(x).cast("decimal(19,0)").alias(n) for n, x in (("a", a), ("l", left), ("r", right)))).select(F.expr("cast(1000000 as decimal(7,0)) * (a * a) div (l * r)")).first()[0]
    assert found == 1_000_000 * a * a // (left * right)


# --- op12 ---


def whitened(spark, rows, **options):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **options).collect()
    return {(r["vec_id"], r["component"]): r for r in found}


def vectors(n=200, d=12, seed=1):
    return np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32) * np.linspace(0.2, 2, d, dtype=np.float32)


def test_whitening(spark):
    v = vectors()
    odd = [(900, None), (901, [float("nan")] * 12), (902, [float("inf")] + [0.0] * 11), (903, [None] + [0.0] * 11), (904, [1.0, 2.0]), (905, [])]
    got = whitened(spark, [(i, x.tolist()) for i, x in enumerate(v)] + odd)
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    c = x - total / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    z = c @ w / np.sqrt(e)
    assert len(got) == n * 12
    for k in range(12):
        own = np.array([got[i, k + 1]["whitened"] for i in range(n)])
        sign = np.sign(own @ z[:, k])
        assert np.abs(own * sign - z[:, k]).max() < 1e-9
        assert abs(got[0, k + 1]["explained"] - e[k] / e.sum()) < 1e-12
    for i in range(n):
        assert got[i, 1]["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total, strict=True))
        assert got[i, 1]["n"] == n and got[i, 1]["identity_error"] < 1e-9


def test_whitening_of_long_vectors():
    """More dimensions than the basis holds: the iteration goes on to certified residuals."""
    v = vectors(500, 200)
    c = v - v.mean(axis=0)
    cov = (c.T @ c / len(c)).astype(float)
    rounds = []
    e, w, residual = whitening.lobpcg(lambda b: (rounds.append(b.shape[1]), cov @ b)[1], 200, 32)
    true = np.linalg.eigvalsh(cov)[::-1][:32]
    assert len(rounds) > 3 and max(rounds) <= 3 * 40 and residual <= whitening.RESIDUAL
    assert np.abs(e - true).max() < 1e-11 * true[0] and np.abs(w.T @ w - np.eye(32)).max() < 1e-11


def test_whitening_odd_rows(spark):
    same = whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert {r["whitened"] for r in same.values()} == {None} and {r["deviation"] for r in same.values()} == {0} and len(same) == 4
    flat = whitened(spark, [(i, [float(i), 3.0, float(i)]) for i in range(10)])
    assert [flat[0, k]["whitened"] is None for k in (1, 2, 3)] == [False, True, True] and flat[0, 1]["identity_error"] < 1e-9
    repeated = whitening.whiten(spark.createDataFrame([(None, [0.5]), (1, [1.5]), (1, [1.5])], "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r["vec_id"]), round(r["whitened"], 6)) for r in repeated) in ([("1", 0.707107), ("1", 0.707107), ("None", -1.414214)], [("1", -0.707107), ("1", -0.707107), ("None", 1.414214)])
    huge = whitened(spark, [(1, [1e15]), (2, [-1e15]), (3, [1e30])])
    assert {k[0] for k in huge} == {1, 2} and huge[1, 1]["deviation"] is None
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_sums_are_exact(spark):
    v = [(i, [(-1.0) ** i * 1e16 + i]) for i in range(50)]
    n, total = whitening.sums(spark.createDataFrame(v, "vec_id long, embedding array<double>").select("embedding"), 1)
    assert n == 50 and total == [sum(int(Fraction(x[0]) * 64) for _, x in v)]


# --- op13 ---


def secrets_by_hand(text):
    """The contract's patterns, as they are written."""
    spans = []
    for kind, name in enumerate(("assign", "access", "hex")):
        pattern = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")[kind]
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m.group(1) if kind == 0 else m.group()) >= (6, 20, 24)[kind]:
                spans.append((m.start(), kind, m.end(), name))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(spans))


def secret_texts():
    rng = random.Random(3)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "ſecret=", "toKen:", "ü", "\n"]
    out = []
    for _ in range(400):
        parts = [rng.choice(bits) if rng.random() < 0.7 else "".join(rng.choices("0123456789abcdefABXZ+/_.=-", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 25))]
        out.append("".join(parts))
    return [*out, None, "", "no secrets here", "token = x" + " " * 50_000 + "y", "token" + " " * 50_000, "a1" * 200_000, "AKIA" * 20_000, out[0]]


def test_base_secrets(spark):
    texts = secret_texts()
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = secrets_by_hand(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [len(re.findall(rf"\b{k}:", want)) for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
        assert got[i]["n_added"] == got[i]["spans"].count("novel:")


def test_novel_secrets(spark):
    """Random keys after sensitive words are reported, identifiers, placeholders and clean texts are not."""
    rng = random.Random(9)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(5, 9))) for _ in range(200)]
    prose = [" ".join(rng.choices(words, k=60)) for _ in range(200)]
    key = lambda k: "".join(rng.choices(string.ascii_letters + string.digits, k=k))
    texts, want = list(prose), {}
    for k in range(60):
        before, after = rng.choice(prose), rng.choice(prose)
        cue = rng.choice(["Authorization: Bearer ", "credentials ", "private key is ", "https://user:", "passphrase "])
        secret = key(rng.choice([16, 24, 40, 64, 200])) + "7z"
        want[len(texts)] = f"novel:{len(before) + 1 + len(cue)}:{len(before) + 1 + len(cue) + len(secret)}"
        texts.append(f"{before} {cue}{secret}{'@example.com' if '//' in cue else ''} {after}")
    clean = len(texts)
    for k in range(60):
        name = "_".join(rng.choices(words, k=3))
        texts.append(f"{rng.choice(prose)} {rng.choice(['Bearer', 'private key', 'credentials'])} {rng.choice([name + '_1', 'x' * 30 + '0', '0' * 40 + 'a'])} {rng.choice(prose)} {key(30)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(docs).collect()}
    assert [i for i in want if got[i] != want[i]] == []
    assert [got[i] for i in range(len(prose)) if got[i]] == []
    assert sum('novel' in got[i] for i in range(clean, len(texts))) <= 3


def test_dictionary(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta gamma7key password=hiddenword"), (2, "alpha beta deadbeefdeadbeefdeadbeef ab"), (3, None)], "doc_id long, text string")
    assert secret_scan.dictionary(docs) == b"alpha beta"
    assert secret_scan.dictionary(docs.limit(0)) == b""


def test_secrets_odd_tables(spark):
    rows = spark.createDataFrame([(None, "token = abcdefgh", "x"), (None, "token = abcdefgh", "x")], "doc_id long, text string, spans string")
    assert [r["n_assign"] for r in secret_scan.find_secrets(rows).collect()] == [1, 1]
    assert secret_scan.find_secrets(rows.limit(0)).count() == 0


def test_many_candidates_take_linear_time():
    """Hundreds of thousands of sensitive words and keys in one text."""
    import time

    text = "bearer a1B2c3D4e5F6g7H8i9 " * 20_000 + "token" * 50_000
    began = time.time()
    secret_scan.scan(text, secret_scan.Novelty(b"some known words"))
    assert time.time() - began < 60


@pytest.mark.parametrize("name", ["op12_whitening", "op13_secret_scan"])
def test_queries(spark, name):
    from quarry.llm import registry

    table = spark.read.parquet(f"{SF}/{'embeddings' if '12' in name else 'documents'}.parquet")
    assert registry.QUERIES[name](spark, SF).count() == table.count() * (32 if "12" in name else 1)


# --- op5: models with a character map ---


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf"])
@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("trim", [True, False])
def test_character_map(rule, byte_fallback, trim):
    """Ids of models with a public normalisation rule's map equal the sentencepiece library's."""
    import sentencepiece

    from quarry.llm import sentencepiece_codec
    from tests.llm.test_llm import message, unigram_model

    parsed = sentencepiece_codec.parse_model(unigram_model(byte_fallback, trim))
    blob = sentencepiece_codec.parse_model(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).charsmap
    spec = message((1, rule), (2, blob), (3, 1), (4, int(trim)), (5, 1))
    pieces = [*parsed.pieces, ("Ａé", -1.0, sentencepiece_codec.USER)]
    model = message(*((1, message((1, p), (2, float(s)), (3, k))) for p, s, k in pieces), (2, message((3, 1), (35, int(byte_fallback)))), (3, spec))
    reference, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    rng = random.Random(1)
    bits = ["a", "abc", "Ａ", "ｂ", "ﬁ", "①", "㍿", "é", "e\u0301", "\u3000", " ", "  ", "\t", "\n", "\u2028", "\u200b", "ｶﾞ", "\u212b", "½", "\r", "\x00", "日本", "…", "\u0301", "\ufeff", "𝒳", "▁", "Ａé"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(1500)] + ["ﬁ " * 20_000]
    assert [x.tolist() for x in codec.encode(texts)] == [reference.encode(t) for t in texts]
    if byte_fallback:
        assert codec.decode(codec.encode(texts)) == [reference.decode(reference.encode(t)) for t in texts]


# --- op9: bounded memory ---


def test_lines_with_little_memory(spark, monkeypatch):
    """A task that remembers few keys, and cells of few words: lines of a long list, one of them of a hundred thousand words, go all the same."""
    from quarry.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SEEN_SLOTS", 4)
    monkeypatch.setattr(line_dedup, "BLOCK_WORDS", 400)
    rng = random.Random(8)
    words = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(400)]
    center = rng.sample(words, 40)
    texts = []
    for i in range(120):
        own = list(center)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(40)] = rng.choice(words)
        texts.append("\n".join([" ".join(own), " ".join(rng.sample(words, 12))]))
    texts += [" ".join(f"w{j}" for j in range(100_000)), " ".join(f"w{j}" for j in range(99_000))]
    seen, want = [], []
    for t in texts:
        near = 0
        for line in t.split("\n"):
            s = frozenset(line.split())
            near += any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen)
            seen.append(s)
        want.append(near)
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["n_exact"] + r["n_near"] for r in sorted(got, key=lambda r: r["doc_id"])] == want


# --- op2: scores word by word ---


def test_toxicity_scores_by_hand(spark):
    """The score of every document: the logistic of the bias and the weights of its different words, each hashed by itself."""
    import math
    import zlib

    from quarry.llm import toxicity
    from quarry.llm.common import doc_crc, hash_words

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    crc = doc_crc(F.col("doc_id"), 5)
    model = toxicity.train(docs.select("doc_id", "text").where(crc != 0), labels.select("doc_id", "toxic").where(crc != 0))
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    assert len(weights) >= 5

    def bucket(word):
        data = word.encode()
        return int(hash_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0][0] >> np.uint64(46))

    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, "/root/testdata/sf0.01").collect()}
    marks = str.maketrans(dict.fromkeys("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", " "))
    for r in docs.collect():
        words = set(re.findall("[^\x20\x09-\x0d]+", (r["text"] or "").translate(marks)))
        z = model.bias + sum(weights.get(b, 0.0) for b in {bucket(w) for w in words})
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.5)
