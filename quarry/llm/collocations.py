"""Phrase collocations by compressed position bitmaps, in the manner of SPAM: shift, AND and popcount.

The texts of a language are laid end to end in shards of about SHARD_WORDS words. In a shard every word has one position; between
pieces (text between punctuation or line breaks) and between documents one position stays empty. A word's bitmap has a
bit for each of its positions and is compressed: only blocks of 16 positions that hold a bit are kept. This vertical
database is written once and texts are not read again. A phrase's bitmap has a bit where an occurrence ends; shifted by one
position and joined by AND with another word's bitmap it is the bitmap of the longer phrase, and since the position after a piece is
empty no phrase reaches into the next piece. Phrases are extended depth-first, a group of prefixes at a time, and the popcounts of the
shards are summed.

Counts are taken level by level: a phrase can only occur LEAST times if its first and its last words do, so a shard extends
just the prefixes that passed. A bitmap of the hashes of the frequent phrases, whose size follows their number up to MOST_FILTER_BITS, tells
the tasks which those are; a phrase that it has by chance is extended for nothing, and the exact counts decide in any case.

A task holds one shard, or one document if that is longer. Counts of a hot word or phrase are merged by task
before they are shuffled; the best of a language are picked in every task before they meet.

Defined results: a null text is empty; a null lang is `und`; repeated rows count each time; words are whole whatever their length; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, discard, hash_words, materialize, mix64, small_batches, table, text_chunks

#: Words of a shard, and words of all languages that a task gathers before it writes its shards.
SHARD_WORDS, GATHERED_WORDS = 1 << 17, 1 << 19
#: Occurrences of a candidate, its words, its share of a shorter phrase at which that is dropped (percent), phrases of a language.
LEAST, MOST_WORDS, COVERED_PERCENT, BEST = 10, 3, 50, 2000
#: Phrases up to which counts are broadcast; a longer list is shuffled.
BROADCAST_PHRASES = 300_000
#: Bits of the filter for each phrase in it, and bits at most (64 MiB).
BITS_EACH, MOST_FILTER_BITS = 16, 1 << 29
#: Blocks compared at once, and entries of prefixes that are extended to the full depth before the next are.
BLOCKS, GROUP = 1024, 1 << 15
#: Counts that a task merges before it passes them on, those it passes on at once, and shards that a task's reader holds.
MERGED, PASSED, ROWS_READ = 1 << 18, 1 << 14, 8
#: Parts by first word in which phrases of two and more words are counted one after the other, so that their shuffles never lie on disk at once.
PARTS = 2
#: Settings of the Parquet writer for rows of megabytes: pages and row groups are looked at after each row, and not after a hundred.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20), "compression": "zstd"}
SHARDS = "lang string, n long, words array<string>, word binary, block binary, bits binary"
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[32, 9]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


# --- the vertical database ---


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of adjacent texts: their bytes without a gap (A-Z lower-cased), their lengths, and the number of each word's piece."""
    kind = _CLASS[data]
    word = kind == 0
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    starts = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | border[:-1]))
    ends = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | border[1:])) + 1
    lowered = data | ((((data - np.uint8(65)) < np.uint8(26)).view(np.uint8)) << np.uint8(5))
    pieces = np.cumsum((kind == 2) | border[:-1])
    return lowered[word], ends - starts, pieces[starts]


def _shard(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[pa.Array, Entries]:
    """The distinct words of texts laid end to end, and their bitmaps as entries (word, block, bits) in order of blocks."""
    data = np.concatenate([p[0] for p in parts])
    sizes = np.concatenate([p[1] for p in parts])
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    new = np.concatenate([np.concatenate(([True], p[2][1:] != p[2][:-1])) for p in parts if len(p[2])])
    position = np.arange(len(sizes)) + np.cumsum(new)
    ids = words.indices.to_numpy()
    key = (position >> 4) * len(words.dictionary) + ids
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    bits = np.bitwise_or.reduceat((np.uint16(1) << (position[order] & 15).astype(np.uint16)), first)
    return words.dictionary.cast(pa.string()), (ids[order][first].astype(np.int32), (position[order][first] >> 4).astype(np.int32), bits)


def _vertical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def shard(lang: str) -> pa.RecordBatch:
        n = sizes.pop(lang)
        words, entries = _shard(held.pop(lang))
        listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.int64()), listed, *(pa.array([x.tobytes()], pa.binary()) for x in entries)], ["lang", "n", "words", "word", "block", "bits"])

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            for _, _, data, offsets in text_chunks(batch.column("text").take(pa.array(np.flatnonzero(codes == code)))):
                part = split_words(data, offsets)
                if not len(part[1]):
                    continue
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part[1])
                if sizes[lang] >= SHARD_WORDS:
                    yield shard(lang)
            if sum(sizes.values()) >= GATHERED_WORDS:
                yield from [shard(x) for x in list(held)]
    yield from [shard(x) for x in list(held)]


def vertical(docs: DataFrame) -> DataFrame:
    """The shards of docs (lang, text): distinct words, and of their bitmaps the entries word (its place), block and bits, as bytes."""
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_vertical, SHARDS)


# --- counting ---


def shifted(entries: Entries) -> Entries:
    """Bitmaps moved on by one position, in order of blocks; what leaves a block goes into the next."""
    name, block, bits = entries
    over = np.flatnonzero(bits >> np.uint16(15))
    stay = bits << np.uint16(1)
    name, block = np.concatenate((name, name[over])), np.concatenate((block, block[over] + 1))
    bits = np.concatenate((stay, np.ones(len(over), np.uint16)))
    order = np.argsort(block, kind="stable")
    order = order[bits[order] != 0]
    return name[order], block[order], bits[order]


def _padded(bits: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(int((end - start).max()))
    inside = at < end[:, None]
    at = np.minimum(at, len(bits) - 1)
    return at, np.where(inside, bits[at], np.uint16(0))


def joined(a: Entries, b: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The AND of all bitmaps of a with all of b that have a position in common: places in a and b, and the bits."""
    out = []
    blocks = np.intersect1d(a[1], b[1])
    ends = [(np.searchsorted(x[1], blocks, "left"), np.searchsorted(x[1], blocks, "right")) for x in (a, b)]
    for i in range(0, len(blocks), BLOCKS):
        (at_a, bits_a), (at_b, bits_b) = (_padded(x[2], start[i : i + BLOCKS], end[i : i + BLOCKS]) for x, (start, end) in zip((a, b), ends, strict=True))
        both = (bits_a[:, :, None] & bits_b[:, None, :]).ravel()
        at = np.flatnonzero(both)
        pair, n = np.divmod(at, bits_b.shape[1])
        out.append((at_a.ravel()[pair], at_b[pair // bits_a.shape[1], n], both[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))


def _names(words: pa.Array, ids: np.ndarray) -> pa.Array:
    columns = [words.take(pa.array(ids[:, j])) for j in range(ids.shape[1])]
    return pc.binary_join_element_wise(*columns, pa.scalar(" ")) if len(columns) > 1 else columns[0]


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    return np.concatenate([np.zeros(0, np.uint64), *(mix64(hash_words(data, offsets)[0] + seed) for _, _, data, offsets in text_chunks(words))])


def _followed(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases of these hashes with one more word."""
    return mix64(prefix * np.uint64(0x9E3779B97F4A7C15) + word)


class Filter:
    """A bitmap of hashes; it has all phrases that are frequent, and by chance some others."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def level_counts(hashes: np.ndarray, entries: Entries, level: int, filters: list[Filter], part: tuple[int, int] = (0, 1)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, occurrences in this shard) of phrases of level words; filters[i] has the frequent phrases of i + 1 words.

    part = (i, n) counts only the phrases whose first word is in the i-th of n parts of all words."""
    kept = filters[0].has(hashes) if filters else np.ones(len(hashes), dtype=bool)
    entries = tuple(x[kept[entries[0]]] for x in entries)

    def descend(ids: np.ndarray, own: np.ndarray, prefix: Entries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count or extend the phrases of word numbers ids and hashes own, whose bitmaps are prefix."""
        depth = ids.shape[1]
        if depth == level:
            counts = np.bincount(prefix[0], np.bitwise_count(prefix[2]), len(ids)).astype(np.int64)
            some = np.flatnonzero(counts)
            yield ids[some], counts[some]
            return
        moved = shifted(prefix)
        p, w, bits = joined(moved, entries)
        key, number = np.unique(moved[0][p].astype(np.int64) * len(hashes) + entries[0][w], return_inverse=True)
        first, last = key // len(hashes), key % len(hashes)
        longer, own = np.column_stack((ids[first], last)), _followed(own[first], hashes[last])
        kept = np.ones(len(key), dtype=bool)
        if depth > 1:
            tail = hashes[longer[:, 1]]
            for j in range(2, depth + 1):
                tail = _followed(tail, hashes[longer[:, j]])
            kept = filters[depth - 1].has(tail)
        if depth < len(filters):
            kept &= filters[depth].has(own)
        new = np.cumsum(kept) - 1
        inside = kept[number]
        number, block, bits = new[number[inside]], entries[1][w[inside]], bits[inside]
        longer, own = longer[kept], own[kept]
        # groups of phrases of about GROUP entries go down to the full depth one after the other
        ends = np.cumsum(np.bincount(number, minlength=len(longer)))
        cuts = [0, *(np.searchsorted(ends, np.arange(GROUP, len(number), GROUP)) + 1).tolist(), len(longer)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low < high:
                here = (number >= low) & (number < high)
                yield from descend(longer[low:high], own[low:high], (number[here] - low, block[here], bits[here]))

    first = entries
    if part[1] > 1:
        own = (hashes % np.uint64(part[1]) == part[0])[entries[0]]
        first = tuple(x[own] for x in entries)
    yield from descend(np.arange(len(hashes))[:, None], hashes, first)


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, Entries]]:
    for batch in batches:
        for row in range(len(batch)):
            entries = tuple(np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("word", np.int32), ("block", np.int32), ("bits", np.uint16)))
            yield batch.column("lang")[row].as_py(), batch.column("words")[row].values, entries


def count_level(shards: DataFrame, level: int, filters: list, least: int = LEAST, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(lang, phrase, f) of the phrases of level words with f of least or more; filters are broadcast Filters of the shorter ones.

    part is as in level_counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.Table:
            found = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
            return found.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])

        for lang, words, entries in _shards_of(batches):
            for ids, counts in level_counts(word_hashes(lang, words), entries, level, [f.value for f in filters], part):
                held.append(pa.table({"lang": pa.array([lang] * len(ids), pa.string()), "phrase": _names(words, ids).cast(pa.string()), "f": counts}))
                size += len(ids)
            if size >= MERGED:
                held = [merged()]
                size = held[0].num_rows
                if size >= MERGED // 2:
                    yield from held[0].combine_chunks().to_batches(PASSED)
                    held, size = [], 0
        if held:
            yield from merged().combine_chunks().to_batches(PASSED)

    found = shards.select("lang", "words", "word", "block", "bits").mapInArrow(run, "lang string, phrase string, f long")
    # tasks have merged their counts: they are dealt out as they are and summed once
    return found.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def frequent_filter(counts: DataFrame, rows: int) -> Filter:
    """The Filter of counts (lang, phrase): at most MOST_FILTER_BITS / 64 rows of 64 bits reach the driver, however many phrases there are."""
    bits = 1 << 12
    while bits < min(MOST_FILTER_BITS, BITS_EACH * rows):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.zeros(len(batch), np.uint64)
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(langs.indices.to_numpy() == code)
                words = pc.split_pattern(batch.column("phrase").take(pa.array(own)), " ")
                hashes = word_hashes(lang, words.flatten()).reshape(len(own), -1)
                slots[own] = functools.reduce(_followed, hashes.T) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (slots & np.uint64(63))).view(np.int64))], ["cell", "bits"])

    cells = counts.select("lang", "phrase").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return Filter(out)


@contextlib.contextmanager
def few_rows_read(spark: SparkSession) -> Iterator[None]:
    """Let Spark's Parquet reader hold a few rows at once, as a shard is a row of megabytes."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ROWS_READ))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# --- candidates ---


def _part(low: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("words", low, n), " ")


def mine(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, covered_percent: int = COVERED_PERCENT, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of 2 to most_words words of docs (lang, text).

    a, l and r are the counts of the phrase, of its first and of its second part at the lowest-scoring cut; n counts the language's words."""
    spark = docs.sparkSession
    shards = materialize(vertical(docs), "phrase-shards", **LONG_ROWS)
    levels, rows, filters, written = [], [], [], [shards]
    with few_rows_read(spark):
        for level in range(1, most_words + 1):
            parts = PARTS if level > 1 else 1
            counted = [materialize(count_level(shards, level, filters, least, (i, parts)), f"phrase-{level}") for i in range(parts)]
            written += counted
            levels.append(functools.reduce(DataFrame.unionByName, counted))
            rows.append(levels[-1].count())
            if level < most_words:
                filters.append(spark.sparkContext.broadcast(frequent_filter(levels[-1], rows[-1])))
    words = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = levels[0]
    for more in levels[1:-1]:
        parts = parts.unionByName(more)
    found = levels[1]
    for more in levels[2:]:
        found = found.unionByName(more)
    found = found.withColumn("words", F.split("phrase", " "))
    # a phrase within a longer one that has enough of its occurrences goes
    size = F.size("words")
    inner = found.where(size > 2).select("lang", F.col("f").alias("longer"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: _part(i, k))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = found.join(broadcast_if_small(inner, sum(rows[2:]), BROADCAST_PHRASES), ["lang", "phrase"], "left")
    left = left.where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(19,0)") < covered_percent * F.col("f").cast("decimal(19,0)"))).drop("longer")
    # every cut, with the counts of both of its parts
    cuts = left.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        known = parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        cuts = cuts.join(broadcast_if_small(known, sum(rows[:-1]), BROADCAST_PHRASES), ["lang", part])
    wide = cuts.withColumns({c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")})
    cut = wide.withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * (a * a) div (l * r)"))
    lowest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r")))).alias("cut")).select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = lowest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)
    out = top.join(F.broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = materialize(out, "phrase-best")
    for f in filters:
        f.destroy()
    discard(*written)
    return out


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
 o AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
 f AS (SELECT lang, size, phrase, count(*) AS f FROM o GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
 c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS v FROM f WHERE size > 1 AND f >= 10),
 inner2 AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([v[1] || ' ' || v[2], v[2] || ' ' || v[3]]) AS phrase, a FROM c WHERE size = 3) GROUP BY 1, 2),
 kept AS (SELECT c.* FROM c LEFT JOIN inner2 i ON c.size = 2 AND c.lang = i.lang AND c.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a),
 cuts AS (SELECT lang, phrase, a, 1 AS k, v[1] AS x, array_to_string(v[2:], ' ') AS y FROM kept UNION ALL SELECT lang, phrase, a, 2, v[1] || ' ' || v[2], v[3] FROM kept WHERE size = 3),
 s AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
 low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
 ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM low WHERE cut = 1)
 SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
