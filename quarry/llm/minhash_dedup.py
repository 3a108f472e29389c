"""MinHash near-dedup with circulant MinHash signatures, banding and exact Jaccard verification.

Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set holds its distinct
five-word shingles (the whole sequence where it has fewer words). Two documents are linked if the Jaccard
similarity of their full sets reaches the threshold; a near-duplicate class is a connected component of links.

Circulant MinHash: one permutation scatters the shingles over the ring of 32-bit numbers, a second one ranks the
ring, and signature coordinate i ranks the ring after turning it by i. No third random permutation is drawn.

Large groups never become pairs. Equal texts are one node. In each bucket every node is first compared with the
bucket's most central node only, then those that are still in several components with the next one; only what is
left after these rounds is compared in pairs of different components, which in a large bucket are blocks of rows whose
links alone leave the task. A pair over the threshold meets in about 14 of the 32 bands, so that it meets in none is a matter of
one in a hundred million. Pairs whose signatures, sketched in four bits a coordinate, lie SLACK standard deviations
below the threshold are not compared in full; that loses a link at the very threshold less than once in a hundred million, as banding does.

Defined results: null or blank texts have an empty set (n_shingles 0), are linked with nothing and form their own
component; repeated rows and equal texts share a component; component_id is the smallest doc_id of a component
and null only where all its doc_ids are null; rows with a null doc_id are kept only in that case; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, discard, hash_shingles, hash_words, materialize, mix64, small_batches, table, text_chunks

SHINGLE_WORDS, BANDS, ROWS = 5, 32, 5
#: Standard deviations below the threshold at which a pair's sketched similarity still lets it be compared in full.
SLACK = 6.0
#: Times that every bucket's nodes are compared with one of them before the rest are compared in pairs.
STAR_ROUNDS = 1
#: Nodes of a bucket with several components above which it is compared block by block.
LARGE_BUCKET = 64
#: Nodes of such a bucket in one block; tasks compare two blocks with each other.
BLOCK_NODES = 400


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash signature (uint32) of a set of 64-bit shingle hashes."""
    ring = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    turns = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(ring), 1024):
        x = ring[None, a : a + 1024] + turns
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x9E3779B1)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band; equal keys of different bands do not meet."""
    key = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for column in sig.reshape(bands, rows).T:
        key = mix64(key ^ column.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return key.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest four bits of each coordinate, sixteen coordinates in a signed 64-bit number."""
    bits = np.zeros(-(-len(sig) // 16) * 16, dtype=np.uint64)
    bits[: len(sig)] = sig & np.uint32(15)
    return (bits.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _most_differ(percent: int, coordinates: int) -> int:
    q = (1 - percent / 100) * 15 / 16
    return math.ceil(coordinates * q + SLACK * math.sqrt(coordinates * q * (1 - q)))


def _may_reach(a: str, b: str, percent: int, coordinates: int) -> Column:
    """Whether two sketches differ in so few coordinates that the full sets may reach the threshold."""
    differ = F.lit(0)
    for i in range(-(-coordinates // 16)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(x)
    return differ <= _most_differ(percent, coordinates)


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys = np.zeros(len(batch), np.int64), np.zeros((len(batch), bands), np.int64)
            sketches = np.zeros((len(batch), -(-bands * rows // 16)), np.int64)
            for a, _, data, offsets in text_chunks(batch.column("text")):
                words, word_offsets, _ = hash_words(data, offsets)
                for i, shingles in enumerate(hash_shingles(words, word_offsets, k), a):
                    if len(shingles):
                        counts[i] = len(shingles)
                        sig = signature(shingles, bands * rows)
                        keys[i], sketches[i] = band_keys(sig, bands, rows), sketch(sig)
            some = np.repeat(counts > 0, bands)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum((counts > 0) * bands))).astype(np.int32), pa.array(keys.ravel()[some]))
            width = sketches.shape[1]
            short = pa.ListArray.from_arrays(np.arange(0, len(batch) * width + 1, width, dtype=np.int32), pa.array(sketches.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(counts), lists, short], ["doc_id", "text_key", "n_shingles", "keys", "sketch"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[np.ndarray] = []
            for _, _, data, offsets in text_chunks(batch.column("text")):
                words, word_offsets, _ = hash_words(data, offsets)
                sets += hash_shingles(words, word_offsets, k)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "shingles"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int, coordinates: int) -> DataFrame:
    """Of candidate pairs (src, dst) those whose full sets reach the threshold."""
    a, b = (nodes.select(F.col("node").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("sketch").alias(f"sketch_{n}")) for n in ("src", "dst"))
    near = pairs.distinct().join(a, "src").join(b, "dst")
    near = near.where(F.least("n_src", "n_dst") * 100 >= F.greatest("n_src", "n_dst") * percent)
    near = materialize(near.where(_may_reach("sketch_src", "sketch_dst", percent, coordinates)).select("src", "dst", "n_src", "n_dst"), "near-pairs")
    wanted = near.select(F.col("src").alias("node")).union(near.select(F.col("dst").alias("node"))).distinct().join(nodes.select("node", "text_key"), "node")
    # equal texts are many where copies are, but each task passes on one of them only
    full = texts.join(wanted, "text_key").groupBy("node").agg(F.first("text").alias("text"))
    sets = full.mapInArrow(_sets(k), "node long, shingles array<long>")
    sets = materialize(sets, "near-sets")
    both = near.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("set_src")), "src").join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("set_dst")), "dst")
    common = F.size(F.array_intersect("set_src", "set_dst")).cast("long")
    links = both.select("src", "dst", "n_src", "n_dst", common.alias("common")).where(F.col("common") * 100 >= (F.col("n_src") + F.col("n_dst") - F.col("common")) * percent)
    links = materialize(links.select("src", "dst"), "near-links")
    discard(near, sets)
    return links


def _compare_blocks(percent: int, coordinates: int):
    """Links between different components of two blocks of one bucket, from the full sets."""
    limit = _most_differ(percent, coordinates)

    def run(rows: pa.Table) -> pa.Table:
        node, component, n, block = (rows.column(c).to_numpy() for c in ("node", "component", "n_shingles", "block"))
        bucket, first, second = (rows.column(c)[0].as_py() for c in ("bucket", "first", "second"))
        sketches = np.stack(rows.column("sketch").to_numpy()).view(np.uint64)
        keys = np.stack(rows.column("keys").to_numpy())
        sets = rows.column("shingles").to_numpy()
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out: list[tuple[int, int]] = []
        inner = np.flatnonzero(block == first)
        outer = np.flatnonzero(block == second)
        for i in inner.tolist():
            js = outer[outer > i] if first == second else outer
            js = js[(component[js] != component[i]) & (np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent)]
            x = sketches[js] ^ sketches[i]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            js = js[np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1) <= limit]
            common = keys[js] == keys[i]
            js = js[keys[i][common.argmax(axis=1)] == bucket]
            for j in js.tolist():
                a, b = find(component[i].item()), find(component[j].item())
                if a != b:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both * 100 >= (len(sets[i]) + len(sets[j]) - both) * percent:
                        root[max(a, b)] = min(a, b)
                        out.append((node[i], node[j]))
        return pa.table({"src": pa.array([x for x, _ in out], pa.int64()), "dst": pa.array([x for _, x in out], pa.int64())})

    return run


def _block_links(cells: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int, coordinates: int) -> DataFrame:
    """A forest of the links between components within large buckets; no group holds more than two blocks of one bucket."""
    wanted = cells.select("node").distinct().join(nodes.select("node", "text_key"), "node")
    full = texts.join(wanted, "text_key").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(full.mapInArrow(_sets(k), "node long, shingles array<long>"), "near-sets")
    blocks = F.ceil(F.col("members") / BLOCK_NODES).cast("int")
    placed = cells.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    rows = placed.select("bucket", "first", "second", "block", "node", "component", "n_shingles", "sketch", "keys").join(sets, "node")
    return rows.groupBy("bucket", "first", "second").applyInArrow(_compare_blocks(percent, coordinates), "src long, dst long")


def minhash_components(docs: DataFrame, percent: int = 85, k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key (md5 of the text, '' for null), n_shingles, component_id for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.md5(text.cast("binary")).alias("text_key"))
    signed = texts.mapInArrow(_signatures(k, bands, rows), "doc_id long, text_key string, n_shingles long, keys array<long>, sketch array<long>")
    grouped = signed.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    entries = nodes.where("n_shingles > 0").select("node", "n_shingles", F.explode("keys").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    buckets = materialize(entries.join(shared, "bucket"), "near-buckets")
    # the head of a bucket is its most central node: the one that meets most others in all its buckets
    support = buckets.groupBy("node").agg(F.sum("members").alias("support"))
    ranked = buckets.join(support, "node").select("bucket", "node", "n_shingles", F.struct("support", (-F.col("node")).alias("rank")).alias("order"))
    ranked = materialize(ranked, "near-ranked")
    discard(buckets)
    words_of = texts.select("text_key", "text")
    rest, links, components = ranked, None, None
    for step in range(STAR_ROUNDS):
        heads = rest.groupBy("bucket").agg((-F.max("order")["rank"]).alias("head"))
        stars = rest.join(heads, "bucket").where("node <> head")
        if components is not None:
            own = components.select(F.col("node").alias("head"), F.col("component").alias("head_component"))
            stars = stars.join(own, "head", "left").where(F.col("component") != F.coalesce("head_component", "head"))
        found = _verified(stars.select(F.col("head").alias("src"), F.col("node").alias("dst")), nodes, words_of, k, percent, bands * rows)
        links = found if links is None else materialize(links.union(found), "near-links")
        components = connected_components(links, "near-star")
        # what is left: buckets that hold several components, without the heads, which have met all others
        left = rest.join(heads, "bucket").where("node <> head").drop("component", "head").join(components, "node", "left")
        left = materialize(left.withColumn("component", F.coalesce("component", "node")), "near-left")
        mixed = left.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members")).where("a <> b").select("bucket", "members")
        rest = materialize(left.drop("members").join(mixed, "bucket"), "near-rest")
        discard(left)

    # each pair of different components is compared once, in the first band where its nodes meet
    cells = materialize(rest.join(nodes.select("node", "sketch", "keys"), "node"), "near-cells")
    small = cells.where(F.col("members") <= LARGE_BUCKET)
    a, b = small.alias("a"), small.alias("b")
    other = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.component") < F.col("b.component"))
    alike = F.least("a.n_shingles", "b.n_shingles") * 100 >= F.greatest("a.n_shingles", "b.n_shingles") * percent
    near = _may_reach("a.sketch", "b.sketch", percent, bands * rows)
    once = F.element_at(F.array_intersect("a.keys", "b.keys"), 1) == F.col("a.bucket")
    pairs = a.join(b, other & alike & near & once).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    more = _verified(pairs, nodes, words_of, k, percent, bands * rows)
    more = more.union(_block_links(cells.where(F.col("members") > LARGE_BUCKET), nodes, words_of, k, percent, bands * rows))
    more = materialize(more, "near-more")
    # links of the second step join components of the first
    tops = components.select(F.col("node"), F.col("component"))
    lifted = more.join(tops.select(F.col("node").alias("src"), F.col("component").alias("c_src")), "src", "left").join(tops.select(F.col("node").alias("dst"), F.col("component").alias("c_dst")), "dst", "left")
    joined = connected_components(lifted.select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst")), "near-all")
    first = nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    full = first.join(joined.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").withColumn("root", F.coalesce("root", "component"))
    smallest = full.where("n_shingles > 0").groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = full.where("n_shingles > 0").join(smallest, "root").select("text_key", "n_shingles", "component_id")
    discard(ranked, rest, cells, more)
    out = texts.select("doc_id", "text_key").join(classes, "text_key", "left")
    return out.select("doc_id", "text_key", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.when(F.col("n_shingles").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Exact pairs from shared shingles, and their closure.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT doc_id AS r, doc_id FROM w UNION SELECT reach.r, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.doc_id
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
