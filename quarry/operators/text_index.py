"""An inverted index for keyword search (K3, T8): postings by term in blocks of documents, block-max pruning, many queries in one job.

build() reads the texts once. A document gets a number; a block is a range of BLOCK_DOCS numbers, so the postings of a term in a block are a short
array whatever the term, and a term of a third of all documents is as many rows as it has blocks. Of each block the index keeps the greatest
frequency and the least length, which bound the score of every document in it. Postings lie in BUCKETS folders by the term's hash and are sorted by
term: a search reads the folders of its terms. A task of the build gets about DEALT postings, however many there are.

search() is exact. It bounds each query's score in every block, scores the FIRST_BLOCKS best-bounded blocks of a query, and then just the blocks
whose bound reaches the k-th score found so far. A block's postings meet SLICE queries at a time, as a product of matrices of which the k best documents
of each query are handed on, so that a task's memory hangs neither on the number of queries nor on that of documents. Texts and queries go through one
analyser.

A null text is empty; a query without a known term has no hits; rows with equal or null keys are documents of their own; ties go by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import shared_path, small_batches

BLOCK_DOCS, BUCKETS, FIRST_BLOCKS = 1024, 64, 16
#: Postings of a task of the build, and those that a Python task gathers before it sorts them.
DEALT, GATHERED = 250_000, 400_000
#: Queries that are scored together (2 to the power of SLICE_BITS), and the blocks that a task scores for so many.
SLICE_BITS, SCORED = 9, 4
SLICE = 1 << SLICE_BITS
#: Rows of slices and terms, or of slices and blocks, up to which they are broadcast; more are shuffled.
BROADCAST_ROWS = 300_000
K1, B = 1.2, 0.75


def analyse(text: Column) -> Column:
    """The terms of a text: runs of letters and digits in lower case, with a ++ or # at their end."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:\+\+|#)?"), F.lit(0))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class TextIndex:
    """Tables under path: docs (doc, key, length, terms, tfs), terms (term, df) and postings (bucket, term, block, max_tf, min_length, hits)."""

    spark: SparkSession
    path: str
    key_type: str

    def table(self, name: str) -> DataFrame:
        schema = {
            "docs": f"doc long, key {self.key_type}, length int, terms array<string>, tfs array<int>",
            "terms": "term string, df long",
            "postings": "term string, block long, max_tf int, min_length int, hits array<struct<doc:long,tf:int,length:int>>, bucket int",
        }[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different terms of each document and how often each occurs, by sorting the documents of a batch together."""
    for batch in batches:
        lists = batch.column("terms")
        lengths = lists.value_lengths().to_numpy()
        coded = lists.flatten().dictionary_encode()
        n = max(1, len(coded.dictionary))
        keys, counts = np.unique(np.repeat(np.arange(len(batch)), lengths) * n + coded.indices.to_numpy(), return_counts=True)
        offsets = pa.array(np.searchsorted(keys, np.arange(len(batch) + 1) * n).astype(np.int32))
        terms, tfs = coded.dictionary.take(pa.array(keys % n)) if len(keys) else pa.array([], pa.string()), pa.array(counts.astype(np.int32))
        columns = [batch.column("doc"), batch.column("key"), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tfs)]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "length", "terms", "tfs"])


def _postings(block_docs: int):
    """The postings of each term in the documents of a task, by block and in order of documents; a block that goes on is held back."""

    def listed(docs: pa.Table) -> pa.RecordBatch:
        docs = docs.combine_chunks()
        lists = docs.column("terms").combine_chunks()
        own = np.repeat(np.arange(len(docs)), lists.value_lengths().to_numpy())
        coded = lists.flatten().dictionary_encode()
        doc, length, tf = docs.column("doc").to_numpy()[own], docs.column("length").to_numpy()[own], docs.column("tfs").combine_chunks().flatten().to_numpy()
        term, block = coded.indices.to_numpy(), doc // block_docs
        order = np.lexsort((doc, term, block))
        doc, length, tf, term, block = (x[order] for x in (doc, length, tf, term, block))
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
        hits = pa.StructArray.from_arrays([pa.array(doc), pa.array(tf), pa.array(length)], ["doc", "tf", "length"])
        grouped = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), hits)
        columns = [coded.dictionary.take(pa.array(term[first])), pa.array(block[first]), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(length, first)), grouped]
        return pa.RecordBatch.from_arrays(columns, ["term", "block", "max_tf", "min_length", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        held = 0
        for batch in batches:
            waiting.append(pa.table(batch).filter(pc.greater(pc.list_value_length(batch.column("terms")), 0)))
            held += len(batch.column("terms").flatten())
            if held < GATHERED:
                continue
            docs = pa.concat_tables(waiting)
            block = docs.column("doc").to_numpy() // block_docs
            over = block != block[-1]
            if over.any():
                yield listed(docs.filter(pa.array(over)))
                docs = docs.filter(pa.array(~over))
            waiting, held = [docs], pc.sum(pc.list_value_length(docs.column("terms"))).as_py()
        docs = pa.concat_tables(waiting) if waiting else None
        if docs is not None and len(docs):
            yield listed(docs)

    return run


def build(docs: DataFrame, key: str, text: str, path: str | None = None) -> TextIndex:
    """Index docs (key, text) under path, or a folder of its own in the shared one.

    Tasks gather the postings of their documents by block, and these are dealt out once, by bucket and a slab of blocks: a bucket of a slab is a task's
    work and a file, and there are so many slabs that it holds about DEALT postings. A block that two tasks have read has two rows of a term, which
    bound its score all the same."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_path(spark, "text-index")
    # numbers of documents are written with their terms, so that a task that is repeated later cannot change them
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(key).alias("key"), analyse(F.col(text)).alias("terms"))
    index = TextIndex(spark, path, numbered.schema["key"].dataType.simpleString())
    numbered.mapInArrow(_counted, f"doc long, key {index.key_type}, length int, terms array<string>, tfs array<int>").write.option("compression", "zstd").parquet(f"{path}/docs")
    hits = "hits array<struct<doc:long,tf:int,length:int>>"
    # one number
    slabs = max(1, math.ceil((index.table("docs").agg(F.sum(F.size("tfs"))).first()[0] or 0) / (BUCKETS * DEALT)))
    each = index.table("docs").select("doc", "length", "terms", "tfs").mapInArrow(_postings(BLOCK_DOCS), f"term string, block long, max_tf int, min_length int, {hits}")
    dealt = each.withColumn("bucket", _bucket(F.col("term"))).repartitionById(BUCKETS * slabs, F.col("bucket") * slabs + F.pmod(F.xxhash64("block"), F.lit(slabs)).cast("int"))
    dealt.sortWithinPartitions("bucket", "term", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    index.table("postings").groupBy("term").agg(F.sum(F.size("hits")).alias("df")).write.parquet(f"{path}/terms")
    return index


def _factor(tf: Column, length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("average")))


def _scores(block_docs: int, k: int):
    """The k best documents, or more where scores are equal, of each query that wants a block, from rows in order of block and slice.

    The first row of a block and slice has the queries that want it (place in the slice, least score); each other one has the postings of a term and the
    queries with that term (place, idf)."""

    def best(at: tuple[int, int], wanted: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
        place, least = wanted.field("place").to_numpy(), wanted.field("least").to_numpy()
        scores = scores[place]
        kth = np.partition(scores, -k, axis=1)[:, -k] if k < block_docs else np.zeros(len(place))
        # what rounding would still bring to the k-th score counts
        row, doc = np.nonzero((scores > 0) & (scores >= np.maximum(kth, least)[:, None] - 1e-6))
        columns = [pa.array((at[1] << SLICE_BITS) + place[row].astype(np.int64)), pa.array(at[0] * block_docs + doc), pa.array(scores[row, doc])]
        return pa.RecordBatch.from_arrays(columns, ["number", "doc", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = wanted = scores = None
        for batch in batches:
            blocks, slices = batch.column("block").to_numpy(), batch.column("slice").to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (slices[1:] != slices[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                part, now = batch.slice(start, end - start), (int(blocks[start]), int(slices[start]))
                if now != at:
                    if at is not None:
                        yield best(at, wanted, scores)
                    at, wanted, scores = now, part.column("wanted").slice(0, 1).flatten(), 0.0
                    part = part.slice(1)
                hits, asked = part.column("hits"), part.column("asked")
                hit, ask = hits.flatten(), asked.flatten()
                tf, length = hit.field("tf").to_numpy(), hit.field("length").to_numpy()
                own, of = (np.repeat(np.arange(len(part)), x.value_lengths().fill_null(0).to_numpy()) for x in (hits, asked))
                factors, idfs = np.zeros((len(part), block_docs)), np.zeros((len(part), SLICE))
                factors[own, hit.field("doc").to_numpy() - now[0] * block_docs] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / part.column("average").to_numpy(zero_copy_only=False)[own]))
                idfs[of, ask.field("place").to_numpy()] = ask.field("idf").to_numpy()
                scores = scores + idfs.T @ factors
        if at is not None:
            yield best(at, wanted, scores)

    return run


def search(index: TextIndex, queries: DataFrame, query: str, text: str, k: int = 20) -> DataFrame:
    """The k best documents of each query of queries (query, text) by BM25 over its different terms: query, key, score (6 digits) and rank.

    The id of a query is its key in the result; queries of one id count as one text."""
    spark, path = index.spark, shared_path(index.spark, "search")
    small_batches(spark)
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    texts = queries.select(F.col(query).alias("query"), F.explode(analyse(F.col(text))).alias("term")).distinct()
    ids = texts.select("query").distinct()
    # a query's number is that of its slice and its place there
    ids.repartition(max(1, math.ceil(ids.count() / SLICE))).withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{path}/queries")
    asked = spark.read.parquet(f"{path}/queries")
    n_asked = asked.count()
    stats = index.table("docs").agg(F.count("*").alias("docs"), F.avg("length").alias("average"))
    weighed = texts.join(few(asked, n_asked).withColumnRenamed("query", "id"), F.col("query").eqNullSafe(F.col("id"))).join(index.table("terms"), "term").join(F.broadcast(stats))
    weighed.withColumn("idf", F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("number", "term", "idf", "average").write.parquet(f"{path}/terms")
    weighed = spark.read.parquet(f"{path}/terms")
    n_terms = weighed.count()
    slice_, place = F.shiftright("number", SLICE_BITS).alias("slice"), F.col("number").bitwiseAND(SLICE - 1).cast("int").alias("place")
    # which folders are read is known beforehand: at most BUCKETS numbers
    buckets = [r[0] for r in weighed.select(_bucket(F.col("term"))).distinct().collect()]
    postings = index.table("postings").where(F.col("bucket").isin(buckets))
    bounds = postings.select("term", "block", "max_tf", "min_length").join(few(weighed, n_terms), "term").groupBy("number", "block").agg(F.sum(F.col("idf") * _factor(F.col("max_tf"), F.col("min_length"))).alias("bound"))
    best = Window.partitionBy("number").orderBy(F.desc("bound"), "block")
    bounds.withColumn("place", F.row_number().over(best)).write.parquet(f"{path}/bounds")
    bounds = spark.read.parquet(f"{path}/bounds")
    with_term = weighed.groupBy("term", slice_).agg(F.collect_list(F.struct(place, "idf")).alias("asked"), F.first("average").alias("average"))

    def scored(blocks: DataFrame) -> DataFrame:
        """(number, doc, score) of the best documents in some blocks (number, block, least)."""
        wanted = blocks.groupBy("block", slice_).agg(F.collect_list(F.struct(place, F.coalesce("least", F.lit(0.0)).alias("least"))).alias("wanted"))
        n_wanted = wanted.count()
        pairs = few(wanted.select("block", "slice"), n_wanted)
        needed = postings.select("term", "block", "hits").join(few(blocks.select("block").distinct(), n_wanted), "block", "left_semi").join(few(with_term, n_terms), "term").join(pairs, ["block", "slice"], "left_semi")
        rows = wanted.unionByName(needed.drop("term"), allowMissingColumns=True)
        dealt = rows.repartition(max(1, math.ceil(n_wanted / SCORED)), "block", "slice").sortWithinPartitions("block", "slice", F.col("wanted").isNull())
        found = dealt.mapInArrow(_scores(BLOCK_DOCS, k), "number long, doc long, score double")
        return found.withColumn("score", F.round("score", 6))

    none = F.lit(None).cast("double").alias("least")
    scored(bounds.where(F.col("place") <= FIRST_BLOCKS).select("number", "block", none)).write.parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    by_score = Window.partitionBy("number").orderBy(F.desc("score"), "doc")
    kth = first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("number", F.col("score").alias("least"))
    # a bound that rounding would still bring to the k-th score counts
    more = bounds.where(F.col("place") > FIRST_BLOCKS).join(kth, "number", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select("number", "block", "least")
    found = first.unionByName(scored(more))
    # of equal scores all that may be among the k stay until their keys are known
    near = found.withColumn("n", F.rank().over(Window.partitionBy("number").orderBy(F.desc("score")))).where(F.col("n") <= k).drop("n")
    keyed = near.join(index.table("docs").select("doc", "key"), "doc").join(few(asked, n_asked), "number")
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "key")))
    return ranked.where(F.col("rank") <= k).select("query", "key", "score", "rank")
