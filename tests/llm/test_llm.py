"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, embedding_dedup, language_id, line_dedup, minhash_dedup, pii, sentencepiece_codec, sharding, toxicity, url_filter
from quarry.llm.common import connected_components, hash_shingles, hash_words

SF = "/root/testdata/sf0.001"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(1, 6))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def documents(spark, texts, start=0):
    return spark.createDataFrame([(i + start if t != "NULLID" else None, t) for i, t in enumerate(texts)], "doc_id long, text string")


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 340)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    expected = components(links, {n for e in links for n in e if e[0] != e[1]})
    assert got == {n: c for n, c in expected.items() if n in got} and len(got) >= len(expected) - 2


def test_word_hashes():
    texts = ["A b  C", "", "a\tb\nc", "é ñ x"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(d) for d in data])
    words, at, _ = hash_words(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert at.tolist() == [0, 3, 3, 6, 9]
    assert words[0:3].tolist() == words[3:6].tolist()
    assert len(hash_shingles(words, at, 5)[0]) == 1


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_texts():
    rng = random.Random(11)
    base = [prose(rng.randint(3, 120), rng) for _ in range(60)]
    out = list(base)
    for t in base[:30]:
        for _ in range(6):
            w = t.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            out.append(" ".join(w))
    center = prose(200, rng).split(" ")
    for _ in range(150):  # a large bucket of similar and less similar texts
        w = list(center)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        out.append(" ".join(w))
    return [*out, *out[:5], None, None, "", "  \n", "One", "one", prose(5000, rng)]


def test_minhash_components(spark):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    expected = components(links, range(len(texts)))
    got = minhash_dedup.minhash_components(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), expected[i]) for i, s in enumerate(sets)}


def test_minhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, None)], "doc_id long, text string")
    got = sorted(str((r["doc_id"], r["component_id"])) for r in minhash_dedup.minhash_components(df).collect())
    assert got == sorted(map(str, [(1, 1), (1, 1), (2, 2), (None, 1), (None, None)]))
    assert minhash_dedup.minhash_components(df.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(1, prose(30, rng)), (2, prose(10, rng)), (3, prose(4, rng)), (4, ""), (5, None), (None, prose(12, rng)), (6, "same " * 15), (7, "Straße ÉTÉ " + prose(9, rng)), (1, prose(14, rng))]
    w = items[0][1].split(" ")
    texts = [prose(50, rng), f"{prose(8, rng)} {' '.join(w[3:14])} {prose(9, rng)}", f"{prose(8, rng)}, {'-'.join(w[3:12])} {prose(9, rng)}", items[1][1].upper(), f"x {items[2][1]}; y", None, "", "!!", "same " * 40, items[7][1] + " " + items[1][1], prose(3000, rng) + " " + items[0][1], items[1][1].upper()]
    found = decontamination.contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()}
    windows = {}
    for i, t in items:
        v = WORD.findall(lowered(t))
        n = min(10, len(v))
        if i is not None and n:
            for p in range(max(1, len(v) - 9)):
                windows.setdefault(tuple(v[p : p + n]), set()).add(i)
    for i, t in enumerate(texts):
        v = WORD.findall(lowered(t))
        hit, ids = set(), set()
        for key, own in windows.items():
            for p in range(len(v) - len(key) + 1):
                if tuple(v[p : p + len(key)]) == key:
                    hit |= set(range(p, p + len(key)))
                    ids |= own
        joined = ",".join(sorted(map(str, ids)))
        assert got[i] == (len(v), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)), i


def lines_by_hand(texts):
    """What is left of each text, by the definition: a line goes if any earlier line is similar."""
    seen, out = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            s = frozenset(line.encode().lower().split())
            if s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                seen.append(s)
                continue
            seen += [s] if s else []
            kept.append(line)
        out.append(None if t is None else "\n".join(kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(9)
    lines = [prose(rng.randint(1, 40), rng) for _ in range(80)]

    def variant(line):
        w = line.split(" ")
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        return " ".join(w)

    texts = ["\n".join(rng.choice([rng.choice(lines), variant(rng.choice(lines)), "", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "\n\n", lines[0] + "\n" + lines[0].upper()]
    clashing = documents(spark, texts).withColumn("n_near", F.lit("clash")).withColumn("gone", F.lit("mine")).withColumn("text_key", F.lit("own"))
    found = line_dedup.dedup_lines(clashing)
    assert found.columns == ["doc_id", "text", "gone", "text_key", "n_lines", "n_exact", "n_near"]
    got = {r["doc_id"]: r for r in found.collect()}
    for i, (t, kept) in enumerate(zip(texts, lines_by_hand(texts), strict=True)):
        assert got[i]["text"] == kept and got[i]["gone"] == "mine" and got[i]["text_key"] == "own", i
        assert got[i]["n_lines"] == (0 if t is None else t.count("\n") + 1)
        kept_lines = 0 if t is None else kept.count("\n") + 1 if kept or t.count("\n") + 1 > got[i]["n_exact"] + got[i]["n_near"] else 0
        assert got[i]["n_exact"] + got[i]["n_near"] == got[i]["n_lines"] - kept_lines
    assert line_dedup.dedup_lines(documents(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 60])
def test_line_dedup_of_many_near_equal_lines(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", block)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(24)]
    texts = []
    for i in range(600):  # lines that differ from one another in up to ten words, under and over the threshold
        w = list(base)
        for at in rng.sample(range(24), rng.randint(0, 5)):
            w[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w) + ("" if i % 3 else "\n" + prose(12, rng)))
    texts.append("a" * 5000 + " " + " ".join(base[1:]))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == lines_by_hand(texts)


def test_lists_that_are_long_pass_on_their_members():
    import pyarrow as pa

    n = line_dedup.LIST_ROWS * 2 + 10
    rows = [(1, 7)] + [(2, k) for k in range(n)] + [(2, n - 1), (3, 8), (3, 9)]
    table = pa.table({"token": pa.array([t for t, _ in rows], pa.int32()), "set_key": [k for _, k in rows], "place": pa.array([10 << 32] * len(rows)), "bits": pa.array([0] * len(rows), pa.int64()), "more": pa.array([0] * len(rows), pa.int64())})
    old, line_dedup.ROWS_AT_ONCE = line_dedup.ROWS_AT_ONCE, 1000
    try:
        out = pa.Table.from_batches(line_dedup._meet(iter(table.to_batches(max_chunksize=700)))).to_pylist()
    finally:
        line_dedup.ROWS_AT_ONCE = old
    assert sorted(r["a"] for r in out if r["token"] == 2) == list(range(n))
    assert [(r["a"], r["b"]) for r in out if r["token"] is None] == [(8, 9)]


def test_line_dedup_odd_rows(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e\nq"), (1, "a b c d e\nq"), (1, "z\nq"), (2, "a b c d e"), (None, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted(str((r["doc_id"], r["text"])) for r in got)
    assert len(got) == len(rows) and texts.count("(None, 'a b c d e')") == 1 and texts.count("(2, '')") == 1 and texts.count("(None, None)") == 1
    # of two texts with one doc_id, one keeps the line q; a repeated row is one document
    ones = [r["text"] for r in got if r["doc_id"] == 1]
    assert sorted(ones) in (["q", "q", "z"], ["", "", "z\nq"])


def test_sentencepiece_parity(spark):
    import sentencepiece

    model = sentencepiece_codec.load_model()
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()] + ["", None, "  a  b ", "x\n\ny", "日本語🙂\x00", "▁a ▁", "word " * 5000]
    reference = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoded = sentencepiece_codec.encode(documents(spark, texts), model)
    got = {r["doc_id"]: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == reference.encode(t or "") and got[i]["roundtrip"] and got[i]["n_tokens"] == len(got[i]["ids"])
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(encoded, model).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts) if "▁" not in (t or ""))


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.op8_language_id(spark, SF).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == {r["doc_id"] for r in held}
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9
    odd = documents(spark, [None, "", "123 !!", "the"]).withColumn("score", F.lit("clash"))
    assert [r["lang_pred"] for r in language_id.identify(odd, language_id.train(docs)).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert language_id.identify(odd, language_id.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.9
    empty = documents(spark, [None, "", "x"])
    model = toxicity.train(empty.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(empty, model).collect())


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 16))
    rows = [base[i % 150] + rng.standard_normal(16) * (0.05 if i % 3 else 0.12) for i in range(600)]
    vectors = [list(map(float, v)) for v in rows] + [list(map(float, rows[0]))] * 3 + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1e38] * 16]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()}
    x = np.array([v for v in vectors[:603]], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[i][0] for i in range(603)])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    assert all(got[i] == (0, i) for i in range(603, 608))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [64, 708, 2000, 4096])
def test_embedding_filters_at_every_size(size):
    x = np.random.default_rng(size).standard_normal((400, 64))
    passed = embedding_dedup.list_decode(x / np.linalg.norm(x, axis=1, keepdims=True), size)
    assert all(len(np.unique(p)) == embedding_dedup.CODES * embedding_dedup.PASSES for p in passed)
    assert embedding_dedup.pair_recall(64, size, 0.9, seed=1) > 0.95 and embedding_dedup.pair_recall(64, size, 0.95, seed=1) > 0.98


@pytest.mark.parametrize("dim", [1, 2, 8, 16])
def test_embedding_filters_of_short_vectors(dim):
    size = embedding_dedup.code_size(dim, 4_000_000, 0.9)
    assert embedding_dedup.pair_recall(dim, size, 0.9, seed=1) > 0.95


URLS = ["http://A.Example.com/en/1?x=/fr/", "https://www.example.com/en/2", "https://example.com/EN/3", "http://x.net/es/1", "http://net/fr/", "http://notexample.com/en/", "http://org/es/", "no scheme", None, "", "http://", "x://h#/en/", "a://b://c/d"]


def test_url_filter(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(URLS):
        rest = (u or "").partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lowered(host)
        fits = [(h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: len(r[0] + r[1])) if fits else None
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[0] + best[1])
        assert got[i]["verdict"] == best[2] if best else got[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    twice = url_filter.judge(df.union(df).withColumn("suffix_share", F.lit("clash"))).collect()
    assert len(twice) == 2 * len(URLS) and {r["suffix_share"] for r in twice} == {"clash"}


def test_url_features_by_hand():
    import pandas as pd

    urls = ["https://a-b.Example.com/en/1?x=1&y=2#z", "", None, "x://é🙂.com", "http://h/" + "a" * 5000]
    host, path = pd.Series(["a-b.example.com", "", "", "é🙂.com", "h"]), pd.Series(["/en/1", "", "", "", "/" + "a" * 5000])
    got = url_filter.lexical_features(pd.Series(urls), host, path)
    for i, u in enumerate(u or "" for u in urls):
        p = np.array([u.count(c) for c in set(u)]) / max(len(u), 1)
        query = u.partition("?")[2].partition("#")[0]
        expected = [len(u), len(host[i]), path[i].count("/"), sum(c.isdigit() for c in u) / max(len(u), 1), -(p * np.log2(p)).sum() if u else 0, query.count("=") + query.count("&"), u.count("-"), host[i].count(".") + 1, max(map(len, host[i].split("."))), u.startswith("https")]
        assert np.allclose(got[i], expected), u
    assert url_filter.lexical_features(pd.Series([], dtype=str), pd.Series([], dtype=str), pd.Series([], dtype=str)).shape == (0, 10)


def labelled_urls(rng, hosts, n):
    """URLs of hosts, to block where they have many digits and parameters, whatever the host."""
    rows = []
    for _ in range(n):
        h, bad = rng.choice(hosts), rng.random() < 0.4
        tail = f"{rng.randrange(10**9):09d}?a={rng.randrange(9999)}&b={rng.randrange(9999)}" if bad else prose(2, rng).replace(" ", "/")
        rows.append((f"http://{h}/{tail}", h, f"/{tail.partition('?')[0]}", "block" if bad else "allow"))
    return rows


def test_url_verdicts_of_suffixes_that_no_label_has(spark):
    rng = random.Random(6)
    columns = "url string, host string, path string, verdict string"
    trained = url_filter.train(spark.createDataFrame(labelled_urls(rng, [f"w.s{i}.com" for i in range(12)], 3000), columns))
    other = labelled_urls(rng, [f"w.t{i}.org" for i in range(12)], 600)
    got = {r["url"]: r for r in url_filter.judge(spark.createDataFrame(other, columns), [], trained).collect()}
    assert np.mean([got[u]["verdict"] == v for u, _, _, v in other]) > 0.9


def test_url_statistics_leave_a_url_out(spark):
    rows = [(f"http://a.x{i}.com/", f"a.x{i}.com", "/", "block" if i % 2 else "allow") for i in range(40)]
    known = spark.createDataFrame([(u, int(v == "block") * 1.0, h[2:], i % 5) for i, (u, h, _, v) in enumerate(rows)], "url string, blocked double, suffix string, fold int")
    got = url_filter._shares(known, "suffix", 0.5).collect()
    # a suffix of one URL: nothing is known of it out of its own fold
    assert all(sum(x is None for x in r["by_fold"]) == 1 and np.isclose(r["share"], (10 * 0.5 + int(r["suffix"][1:-4]) % 2) / 11) for r in got)


def test_url_filter_on_the_tables(spark):
    got = url_filter.op6_url_filter(spark, "/root/testdata/sf0.01").toPandas()
    free = got[got["rule"].isna()]
    unseen = free[free["host"].str.endswith(".org")]
    assert len(unseen) and unseen["block_score"].max() < 0.98 and unseen["block_score"].nunique() > 1


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert (((url_filter.fit_trees(x, y).score(x)) > 0) == y).mean() > 0.95


def test_sharding(spark, tmp_path):
    data = sharding.ShardedDataset(spark, f"file://{tmp_path}/d", target=30_000, small=2_000)
    rows = [(i % 50 if i % 7 else None, prose(20) if i % 5 else None, "z") for i in range(600)]
    for k in range(6):
        df = spark.createDataFrame(rows[k * 100 : k * 100 + 100], "doc_id long, text string, shard string").coalesce(1)
        data.append(df)
        data.compact()
    assert data.append(spark.createDataFrame([], "doc_id long, text string, shard string")).version == data.manifest().version
    got = data.read()
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(key(r) for r in got.collect()) == sorted((str(a), str(b)) for a, b, _ in rows)
    assert len(data.manifest().shards) < 6 and got.select("version").distinct().count() == 1
    before = data.manifest()
    with pytest.raises(RuntimeError):
        data._commit(before.version, list(before.shards))
    data.vacuum()
    assert data.manifest() == before and data.read().count() == 600


def test_sharding_merges_to_the_target_size(spark, tmp_path):
    data = sharding.ShardedDataset(spark, f"file://{tmp_path}/d", target=40_000, small=2_000)
    long = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=30_000))
    for k in range(3):
        rows = [(k * 400 + i, prose(30) if i % 50 else long[i:]) for i in range(400)]
        data.append(spark.createDataFrame(rows, "doc_id long, text string").repartition(20))
        data.compact(keep_old=False)
    shards = data.manifest().shards
    assert sorted(r["doc_id"] for r in data.read().collect()) == list(range(1200))
    assert len(shards) < 30 and max(s.size for s in shards) < 4 * data.target
    assert sum(f.stat().st_size for f in (tmp_path / "d" / "data").rglob("*.parquet")) == sum(s.size for s in shards)
    other = sharding.ShardedDataset(spark, data.path)  # a writer that has seen an older version
    with pytest.raises(RuntimeError):
        other._commit(data.manifest().version, [])


def test_sharding_query_has_the_production_target(spark, monkeypatch):
    made = []
    start = sharding.ShardedDataset.__init__
    monkeypatch.setattr(sharding.ShardedDataset, "__init__", lambda self, *a, **k: (start(self, *a, **k), made.append(self.target))[0])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")
    found = sharding.op4_sharding(spark, SF)
    rows = found.drop("shard", "version")
    assert rows.count() == docs.count() and not rows.exceptAll(docs).count() and found.select("version").distinct().count() == 1
    assert made == [sharding.TARGET_BYTES] == [128 << 20]


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark):
    rng = random.Random(4)
    pieces = ["a@b.c", "x.y+z@m-1.example.com", "a@b", "a@b.c_d@e.f", "a@b..c@d.e", "1.2.3.4", "001.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111  1111111111111", "79927398713", "+1 (269) 555-3296", "+1", "+12345678", "+1234567890123456", "++49 30 1234567", "é", "🙂", " ", "\n", "@", ".", "-", "7", "mail", "(269) 555-3296", "bob at example dot com", "\ue000\ue001\ue002"]
    texts = [None, "", *pieces, "1 2 " * 4000, "a.b" * 4000 + "@c.d", *["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(400)]]
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in spans) for k in range(4)], (t, spans, got[i])
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (t, joined, got[i])
        assert set(joined.split(",")) <= set(got[i]["spans"].split(",")) or not joined


def test_pii_long_domains(spark):
    texts = ["a@" + "b." * n + "c " + tail for n in (1000, 5000, 200_000) for tail in ("", "x@y.z")] + ["a@" + "b." * 5000 + ".c@d.e"]
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)]
        assert got[i]["n_email"] == len(spans)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"email:{a}:{b}" for a, b in spans).encode()).hexdigest()


def test_em_finds_the_reliable_labelers():
    patterns = [(0, (1, 1, 1, -1, 1), 50.0), (0, (0, 0, 0, -1, 0), 50.0), (0, (1, 1, 0, -1, 1), 5.0), (0, (0, 0, 1, -1, 0), 5.0)]
    share, posterior = pii.estimate(patterns)
    assert 0.4 < share[0] < 0.6 and posterior[0, (1, 1, 0, -1, 1)] > 0.9 > 0.1 > posterior[0, (0, 0, 1, -1, 0)]


def test_pu_risk_and_its_gradient():
    rng = np.random.default_rng(1)
    xp, xu, prior = rng.integers(0, 2, (30, 5)).astype(float), rng.integers(0, 2, (70, 5)).astype(float), 0.3
    for scale in (0.1, 6.0):
        w, b = rng.standard_normal(5) * scale, -2.0 * scale

        def by_hand(v):
            s = lambda x: 1 / (1 + np.exp(-(x @ v[:5] + v[5])))
            positive = prior * np.mean([-np.log(s(x)) for x in xp])
            negative = np.mean([-np.log(1 - s(x)) for x in xu]) - prior * np.mean([-np.log(1 - s(x)) for x in xp])
            return positive, negative

        v = np.append(w, b)
        positive, negative, gradient = toxicity.risk(w, b, xp, xu, prior)
        assert np.allclose((positive, negative), by_hand(v))
        goal = (lambda v: sum(by_hand(v))) if negative >= 0 else (lambda v: -by_hand(v)[1])
        steps = [(goal(v + h) - goal(v - h)) / 2e-6 for h in np.eye(6) * 1e-6]
        assert np.allclose(gradient, steps, atol=1e-6)
    # where the unlabelled texts look less positive than the positives among them would make them, the corrected risk is under 0
    assert toxicity.risk(np.array([5.0]), -2.0, np.ones((10, 1)), np.zeros((10, 1)), 0.5)[1] < 0


def test_toxicity_odd_rows(spark):
    rows = [(i, f"bad word{i % 7} {prose(5)}" if i % 4 == 0 else prose(8)) for i in range(200)]
    docs = spark.createDataFrame([*rows, *[(0, "bad again")] * 3, (None, "bad"), (500, "bad " * 300_000), (501, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200, 2)] + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[500] > by_id[501] and by_id[4] > by_id[1]


def test_language_id_odd_rows(spark):
    words = {f"l{i}": "".join(chr(0x3400 + 40 * i + k) for k in range(20)) for i in range(300)}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(words.items())], "doc_id long, text string, lang string")
    languages, _ = language_id.train(docs)
    assert languages == sorted(words)
    odd = spark.createDataFrame([(None, words["l5"]), (1, words["l7"]), (1, words["l7"]), (2, words["l9"] * 30_000)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in language_id.identify(odd, language_id.train(docs)).collect())
    assert got == [("1", "l7"), ("1", "l7"), ("2", "l9"), ("None", "l5")]
    assert language_id.identify(odd.limit(0), language_id.train(docs)).count() == 0


def test_language_id_by_hand(spark):
    """Naive Bayes written out: log prior and the sum of the log shares of all grams."""
    rows = [(0, "aab ab", "x"), (1, "bba ba", "y"), (2, "ab ab", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {lang: np.full(language_id.BUCKETS, 0.5) for lang in "xy"}
    for _, text, lang in rows:
        for b in language_id.gram_buckets(text):
            np.add.at(counts[lang], b, 1)
    prior = {"x": 2 / 3, "y": 1 / 3}
    for r in language_id.identify(spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "ba", "aabba", "b a"])], "doc_id long, text string"), language_id.train(docs)).collect():
        logs = {lang: np.log(prior[lang]) + sum(np.log(c[b] / c.sum()).sum() for b in language_id.gram_buckets(r["text"])) for lang, c in counts.items()}
        best = max(logs, key=logs.get)
        assert r["lang_pred"] == best and np.isclose(r["score"], np.exp(logs[best]) / sum(np.exp(v) for v in logs.values()))


def card(rng, right=True):
    d = [4] + [rng.randrange(10) for _ in range(14)]
    total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(d))
    return "".join(map(str, d)) + str((10 - total + (0 if right else rng.randint(1, 9))) % 10)


def test_pii_adds_spans_of_planted_data(spark):
    rng = random.Random(8)
    texts, planted = [], set()
    for i in range(300):
        parts = [prose(6, rng) + " "]
        for _ in range(2):
            kind = rng.choice(["twice", "wrong", "alone", "phone", "order", "email", "plain"])
            found = []
            if kind == "twice":
                found = [("card", card(rng), " "), ("card", card(rng), " ")]
            elif kind == "wrong":
                found = [(None, card(rng, right=False), " ")]
            elif kind == "alone":
                found = [(None, card(rng), " ")]  # a base span
            elif kind == "phone":
                found = [(None, "call ", ""), ("phone", f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", " ")]
            elif kind == "order":
                found = [(None, f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", " ")]  # a base span
            elif kind == "email":
                found = [(None, "mail ", ""), ("email", f"ann{rng.randrange(99)} at example dot com", " ")]
            for name, value, after in found:
                if name:
                    start = sum(map(len, parts))
                    planted.add((i, name, start, start + len(value)))
                parts.append(value + after)
            parts.append(prose(4, rng) + " ")
        texts.append("".join(parts))
    got = pii.find_pii(documents(spark, texts)).collect()
    added = set()
    for r in got:
        base = {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(texts[r["doc_id"]])}
        more = [s.split(":") for s in r["spans"].split(",") if s and s not in base]
        assert r["n_added"] == len(more)
        added |= {(r["doc_id"], k, int(a), int(b)) for k, a, b in more}
    assert len(added & planted) >= 0.9 * len(planted) and len(added & planted) >= 0.9 * len(added)


def test_pii_odd_rows(spark):
    df = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string").withColumn("cands", F.lit("clash")).withColumn("spans", F.lit("x"))
    assert [r["spans"] for r in pii.find_pii(df).collect()] == ["email:0:5"] * 3
    assert pii.find_pii(df.limit(0)).count() == 0


def message(*fields):
    """A protobuf message of (number, value): int, float, str or bytes."""
    import struct

    def varint(v):
        out = bytearray()
        while True:
            out.append(v & 127 | (128 if v > 127 else 0))
            v >>= 7
            if not v:
                return bytes(out)

    out = b""
    for number, v in fields:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


def unigram_model(byte_fallback, trim):
    """A unigram model written by hand: single letters, pieces of the vocabulary's words and, with fallback, all bytes."""
    rng = random.Random(2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = {("▁" if rng.random() < 0.5 else "") + w[: rng.randint(1, 6)] for w in VOCABULARY} - set("abcdefghij▁é.")
    pieces += [(p, -2.0 - rng.random() * 8, 1) for p in ["▁", *"abcdefghijé.", *sorted(words)]]
    spec = message((1, "identity"), (3, 1), (4, int(trim)), (5, 1))
    return message(*((1, message((1, p), (2, s), (3, k))) for p, s, k in pieces), (2, message((3, 1), (35, int(byte_fallback)))), (3, spec))


@pytest.mark.parametrize(("byte_fallback", "trim"), [(True, False), (True, True), (False, False)])
def test_unigram_parity(spark, byte_fallback, trim):
    import sentencepiece

    model = unigram_model(byte_fallback, trim)
    parsed = sentencepiece_codec.parse_model(model)
    assert parsed.model_type == 1 and parsed.byte_fallback == byte_fallback and parsed.remove_extra_whitespaces == trim
    rng = random.Random(3)
    texts = [prose(rng.randint(1, 60), rng) for _ in range(80)] + ["", None, "é.é a", " a  b " if byte_fallback else "a b", prose(4000, rng)]
    texts += ["xyz 日本 🙂 a", "tab\there"] if byte_fallback else []
    reference = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode(documents(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == reference.encode(t or ""), (i, t)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(sentencepiece_codec.encode(documents(spark, texts), model), model).collect()}
    assert all(back[i] == reference.decode(reference.encode(t or "")) for i, t in enumerate(texts))


def test_sentencepiece_odd_rows(spark):
    model = sentencepiece_codec.load_model()
    df = spark.createDataFrame([(None, "ab"), (1, "ab"), (1, "ab")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    assert len({tuple(r["ids"]) for r in sentencepiece_codec.encode(df, model).collect()}) == 1
    assert sentencepiece_codec.encode(df.limit(0), model).count() == 0
