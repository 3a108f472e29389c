"""Line dedup: an exact set-similarity join of lines that removes later matches.

A line's tokens are its distinct words (runs of characters other than ASCII white space, A-Z lower-cased). A line is
removed if an earlier line, in the order (doc_id, line number), has a token set of Jaccard similarity 0.8 or more,
whether that line is itself kept or not. Lines without words are kept as they are.

The join is a prefix filter: tokens are ordered by rarity, counted over all lines in a table of RANK_BUCKETS hashed
counts (its size is fixed, and any total order gives an exact join), and two sets that reach the threshold share a
token of their prefixes of n - ceil(0.8 n) + 1 tokens. Sets meet in the lists of their prefix tokens, which Spark deals
out and sorts by token; tasks go through them list by list. The length filter, the positional filter (at the first token
that two sets share no more than the rest of the shorter one can follow) and a bitmap filter (sets differ in at least
as many tokens as their bitmaps in bits) prune pairs there, all without loss, and Jaccard is verified on the full sets
of 64-bit word hashes, read again from the texts. Equal sets are one class from the start, named by two 64-bit keys.

Lists of near duplicates never become pairs: a list of which more than DENSE pairs a member pass the filters, or that has
more than LIST_ROWS members, passes on its members instead. These are compared with their full sets in blocks
of BLOCK_ROWS, and only the later of two similar sets comes out; members of longer lists that their own block leaves undecided
are then compared with all other blocks of the list.

Defined results: null texts stay null and have no lines; texts of blank lines stay; a document of which nothing is
left keeps an empty text; of different texts with one doc_id the order is that of their xxhash64; rows that repeat both are one
document and keep the same lines; documents with a null doc_id come first; an empty table gives an empty result; other
columns are carried along, and those with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, discard, free_name, hash_words, materialize, mix64, small_batches, table, text_chunks

RANK_BUCKETS = 1 << 21
#: Jaccard similarity of 4 / 5 = 0.8, as a fraction for exact arithmetic.
NEAR = (4, 5)
#: Rows of fixed width up to which a table of lines or documents to look at again is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Lines numbered in one call; a number and a 44-bit token hash share 64 bits, so that one sort serves both.
LINES_AT_ONCE, TOKEN_BITS = 1 << 20, 44
#: Members of a list that are always compared in pairs, pairs a member beyond which a longer list is one of near
#: duplicates, and members beyond which a list is always cut into blocks.
SHORT_LIST, DENSE, LIST_ROWS = 64, 8, 4096
#: Members of such a list in one block.
BLOCK_ROWS, BLOCK_WORDS = 1024, 1 << 20
#: Keys that a task remembers to count and join equal lines once: 8 MB.
SEEN_SLOTS = 1 << 20
#: Rows of the sorted lists that a task handles at once.
ROWS_AT_ONCE = 1 << 16
KEY = ["set_key", "set_more"]


@dataclass
class Lines:
    """Lines that have words: row and number of each, and their sorted distinct tokens, those of line i from cuts[i] to cuts[i + 1]."""

    row: np.ndarray
    number: np.ndarray
    cuts: np.ndarray
    tokens: np.ndarray

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two signed 64-bit keys of each token set."""
        if not len(self.row):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.diff(self.cuts).astype(np.uint64)
        mixed = mix64(self.tokens ^ np.uint64(0xA24BAED4963EE407))
        one = mix64(np.add.reduceat(mixed, self.cuts[:-1]) + size)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        two = mix64(np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), self.cuts[:-1]) ^ size)
        return one.view(np.int64), two.view(np.int64)


def line_sets(column: pa.Array) -> Iterator[Lines]:
    for a, _, data, offsets in text_chunks(column):
        breaks = np.flatnonzero(data == 10) + 1
        all_starts = np.union1d(offsets[:-1], breaks)
        all_starts = all_starts[all_starts < len(data)]
        words, at, _ = hash_words(data, np.append(all_starts, len(data)))
        rows = np.searchsorted(offsets, all_starts, "right") - 1
        numbers = np.arange(len(all_starts)) - np.searchsorted(all_starts, offsets[rows])
        for first in range(0, len(all_starts), LINES_AT_ONCE):
            last = min(first + LINES_AT_ONCE, len(all_starts))
            own = np.repeat(np.arange(last - first, dtype=np.uint64) << np.uint64(TOKEN_BITS), np.diff(at[first : last + 1]))
            own |= words[at[first] : at[last]] >> np.uint64(64 - TOKEN_BITS)
            own.sort()
            fresh = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
            line = (own >> np.uint64(TOKEN_BITS)).astype(np.int32)
            begins = np.flatnonzero(np.diff(line, prepend=np.int32(-1)))
            own &= np.uint64((1 << TOKEN_BITS) - 1)
            which = line[begins] + first
            yield Lines(a + rows[which], numbers[which], np.append(begins, len(own)), own)


def _nothing_seen() -> np.ndarray:
    """A table of the keys seen, each in the slot of its lowest bits; a slot without a key holds a number that belongs into another."""
    return np.arange(SEEN_SLOTS, dtype=np.int64) ^ 1


def _new(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which keys are not in the table, into which they go. A key that another one has driven out is new again, as is one that repeats within
    keys: it is counted and joined once more, as that of another task is."""
    slots = keys & (SEEN_SLOTS - 1)
    out = seen[slots] != keys
    seen[slots] = keys
    return out


def prefix_size(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens of a set of n of which two similar sets share one."""
    return n - -(-n * NEAR[0] // NEAR[1]) + 1


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(RANK_BUCKETS - 1)).astype(np.int64)


def _lines_and_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that has words; at the end one for each bucket (bucket, n): the task's different lines with a token of it."""
    counts = np.zeros(RANK_BUCKETS, dtype=np.int64)
    seen = _nothing_seen()
    names = ["doc_id", "text_key", "line", *KEY, "bucket", "n"]
    for batch in batches:
        for lines in line_sets(batch.column("text")):
            one, two = lines.keys()
            fresh = np.repeat(_new(one, seen), np.diff(lines.cuts))
            np.add.at(counts, _buckets(lines.tokens[fresh]), 1)
            rows = pa.array(lines.row)
            none = pa.nulls(len(one), pa.int32()), pa.nulls(len(one), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(lines.number.astype(np.int32)), pa.array(one), pa.array(two), *none], names)
    at = np.flatnonzero(counts)
    none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(counts[at])], names)


def _gathered(counted: DataFrame) -> np.ndarray:
    """Lines with a token of each bucket, over all tasks, as an array of RANK_BUCKETS numbers: 8 MB whatever the input."""
    rows = counted.groupBy("bucket").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(RANK_BUCKETS, dtype=np.int32)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _by_rarity(lines: Lines, rarity: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Places of the tokens, each line's from the rarest to the commonest, ties by hash."""
    if len(rarity) < 1 << 22 and len(lines.row) < 1 << 20:
        packed = (line.astype(np.uint64) << np.uint64(44)) | (np.minimum(rarity, (1 << 22) - 1).astype(np.uint64) << np.uint64(22)) | np.arange(len(rarity), dtype=np.uint64)
        packed.sort()
        return (packed & np.uint64((1 << 22) - 1)).astype(np.int64)
    return np.lexsort((np.minimum(rarity, (1 << 22) - 1), line))


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        seen = _nothing_seen()
        for batch in batches:
            for lines in line_sets(batch.column("text")):
                (keys, _), n = lines.keys(), np.diff(lines.cuts)
                fresh = _new(keys, seen)
                if not fresh.any():
                    continue
                lines = Lines(lines.row[fresh], lines.number[fresh], np.append(0, np.cumsum(n[fresh])), lines.tokens[np.repeat(fresh, n)])
                keys, n = keys[fresh], n[fresh]
                # a bitmap of 128 bits, one for each token
                bit, second = np.uint64(1) << (lines.tokens >> np.uint64(21) & np.uint64(63)), (lines.tokens >> np.uint64(27) & np.uint64(1)) == 1
                bits, more = (np.bitwise_or.reduceat(np.where(half, bit, np.uint64(0)), lines.cuts[:-1]) for half in (~second, second))
                rarity = counts[_buckets(lines.tokens)]
                line = np.repeat(np.arange(len(n), dtype=np.int32), n)
                order = _by_rarity(lines, rarity, line)
                pos = np.arange(len(line)) - np.repeat(lines.cuts[:-1], n)
                # a token of one line only meets none; these come first in the order
                lone = rarity[order] <= 1
                use = (pos < np.repeat(prefix_size(n), n)) & ~lone
                held = np.bincount(line[use], minlength=len(n))
                some = held > 0
                start = np.bincount(line[lone], minlength=len(n))
                tokens = (lines.tokens[order[use]] >> np.uint64(TOKEN_BITS - 32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(held[some]))).astype(np.int32), pa.array(tokens))
                columns = [keys[some], ((n << 32) + start)[some], bits[some].view(np.int64), more[some].view(np.int64)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), lists], ["set_key", "size_start", "bits", "more", "prefix"])

    return run


def _close_pairs(token: np.ndarray, place: np.ndarray, bits: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by token: the pairs (two arrays of places) within lists that pass the filters, and which rows are in dense lists."""
    n, pos = place >> 32, place & 0xFFFFFFFF
    begins = np.flatnonzero(np.diff(token, prepend=token[0] ^ 1))
    members = np.diff(np.append(begins, len(token)))
    lists = np.repeat(np.arange(len(begins)), members)
    at = np.arange(len(token)) - begins[lists]
    left = n - pos - 1
    passed, dense = np.zeros(len(begins), dtype=np.int64), np.zeros(len(begins), dtype=bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(at > 0)
    step = 1
    while len(rows):
        a, b = rows, rows - step
        both = n[a] + n[b]
        # overlap o gives Jaccard o / (both - o) >= 4 / 5 where 9 o >= 4 both
        fit = (np.minimum(n[a], n[b]) * NEAR[1] >= np.maximum(n[a], n[b]) * NEAR[0]) & ((np.minimum(left[a], left[b]) + 1) * 9 >= both * 4)
        a, b, both = a[fit], b[fit], both[fit]
        differ = np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64) + np.bitwise_count(more[a] ^ more[b])
        fit = differ * 9 <= both
        if fit.any():
            found.append((a[fit], b[fit]))
            passed += np.bincount(lists[a[fit]], minlength=len(begins))
            dense = (members > SHORT_LIST) & (passed > DENSE * members)
            rows = rows[~dense[lists[rows]]]
        step += 1
        rows = rows[at[rows] >= step]
    a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    kept = ~dense[lists[a]]
    return a[kept], b[kept], dense[lists]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From prefix rows sorted by token and set_key: pairs (a, b) that pass the filters, and members (token, a) of dense or long lists."""

    def members(token: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(key), pa.nulls(len(key), pa.int64())], ["token", "a", "b"])

    def compared(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, key, place, bits, more = rows
        if len(token):
            a, b, dense = _close_pairs(token, place, bits.view(np.uint64), more.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int32()), pa.array(np.minimum(key[a], key[b])), pa.array(np.maximum(key[a], key[b]))], ["token", "a", "b"])
            yield members(token[dense], key[dense])

    held: list[list[np.ndarray]] = []
    waiting, last, too_long = 0, None, None
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("token", "set_key", "place", "bits", "more")]
        if not len(rows[0]):
            continue
        # a set that several tasks have made is several rows
        same = np.zeros(len(rows[0]), dtype=bool)
        same[1:] = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        same[0] = last == (rows[0][0], rows[1][0])
        last = rows[0][-1], rows[1][-1]
        rows = [x[~same] for x in rows]
        if too_long is not None:
            own = rows[0] == too_long
            yield members(rows[0][own], rows[1][own])
            rows = [x[~own] for x in rows]
            if len(rows[0]):
                too_long = None
        held.append(rows)
        waiting += len(rows[0])
        if waiting >= ROWS_AT_ONCE:
            rows = [np.concatenate([h[i] for h in held]) for i in range(5)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # where the last list, which may go on, begins
            rest = [x[cut:] for x in rows]
            if len(rest[0]) > LIST_ROWS:
                too_long = rest[0][0]
                yield members(rest[0], rest[1])
                rest = [x[:0] for x in rest]
            yield from compared([x[:cut] for x in rows])
            held, waiting = [rest], len(rest[0])
    if held:
        yield from compared([np.concatenate([h[i] for h in held]) for i in range(5)])


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted distinct word hashes of the wanted lines of each text."""
    for batch in batches:
        found: list[dict] = []
        lines: list[bytes] = []
        for doc_id, text_key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "wanted")), strict=True):
            own = text.encode().split(b"\n")
            for w in wanted:
                found.append({"doc_id": doc_id, "text_key": text_key} | w)
                lines.append(own[w["line"]])
        if not found:
            continue
        offsets = np.cumsum([0] + [len(x) for x in lines])
        words, at, _ = hash_words(np.frombuffer(b"".join(lines), np.uint8), offsets)
        sets = [np.unique(words[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
        types = {"doc_id": pa.int64(), "text_key": pa.int64(), "line": pa.int32(), "set_key": pa.int64(), "set_more": pa.int64()}
        yield pa.RecordBatch.from_arrays([*(pa.array([f[c] for f in found], t) for c, t in types.items()), lists], [*types, "words"])


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_key, set_more, first and words of the classes (set_key, set_more, first) in wanted, read from the documents of their first lines."""
    spots = wanted.select(F.col("first.doc_id").alias("in_id"), F.col("first.text_key").alias("in_key"), F.struct(F.col("first.line").alias("line"), *KEY).alias("spot"))
    places = materialize(spots.groupBy("in_id", "in_key").agg(F.collect_list("spot").alias("wanted")), "line-places")
    here = places.agg(F.sum(F.size("wanted"))).first()[0] or 0
    found = docs.join(broadcast_if_small(places, here, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("text_key") == F.col("in_key")))
    sets = found.select("doc_id", "text_key", "text", "wanted").mapInArrow(_word_sets, "doc_id long, text_key long, line int, set_key long, set_more long, words array<long>")
    # rows that repeat a document give a set again
    sets = sets.select(*KEY, F.struct("doc_id", "text_key", "line").alias("first"), "words")
    sets = materialize(sets.groupBy(*KEY).agg(F.first("first").alias("first"), F.first("words").alias("words")).withColumn("n_words", F.size("words").cast("long")), "line-sets")
    discard(places)
    return sets


def _order(doc_id: pa.Array, text_key: pa.Array, line: pa.Array) -> np.ndarray:
    """Rows in the order of lines, null doc_ids first."""
    ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
    return np.lexsort((line.to_numpy(), text_key.to_numpy(), ids, ~doc_id.is_null().to_numpy(zero_copy_only=False)))


def _later_ones(rows: pa.Table) -> pa.Table:
    """Of the rows of one cell: those that ask (asks) and have a similar earlier one here."""
    rows = rows.combine_chunks()
    first = rows.column("first").combine_chunks()
    order = _order(*(first.field(c) for c in ("doc_id", "text_key", "line")))
    sets = [rows.column("words")[i].values.to_numpy().view(np.uint64) for i in order.tolist()]
    asks = rows.column("asks").to_numpy()[order]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    bitmaps = np.zeros((len(sets), 8), dtype=np.uint64)
    for i, s in enumerate(sets):
        np.bitwise_or.at(bitmaps[i], (s >> np.uint64(61)).astype(np.int64), np.uint64(1) << (s >> np.uint64(55) & np.uint64(63)))
    gone = []
    for i in np.flatnonzero(asks).tolist():
        both = n[:i] + n[i]
        near = np.minimum(n[:i], n[i]) * NEAR[1] >= np.maximum(n[:i], n[i]) * NEAR[0]
        near &= np.bitwise_count(bitmaps[:i] ^ bitmaps[i]).sum(axis=1, dtype=np.int64) * 9 <= both
        for j in np.flatnonzero(near).tolist():
            if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) * 9 >= both[j] * 4:
                gone.append(i)
                break
    return rows.select(KEY).take(pa.array(order[gone], pa.int64()))


def _blocks() -> Column:
    """Blocks of a list: of BLOCK_ROWS sets, or fewer where these are long."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("int")


def _dense_matches(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Keys of the members (token, set_key) of long lists that have a similar earlier member."""
    rows = members.distinct().join(sets, "set_key")
    sizes = rows.groupBy("token").agg(_blocks().alias("blocks"))
    rows = materialize(rows.join(sizes, "token").withColumn("block", F.pmod(F.xxhash64(*KEY), "blocks").cast("int")), "line-dense")
    keys = "set_key long, set_more long"
    found = materialize(rows.withColumn("asks", F.lit(True)).groupBy("token", "block").applyInArrow(_later_ones, keys).distinct(), "line-later")
    long = rows.where("blocks > 1")
    open_ = materialize(long.join(found, KEY, "left_anti"), "line-open")
    counts = open_.groupBy("token").agg(_blocks().alias("parts"))
    # open members (in parts) against all blocks: a cell has one part and one block, less what has met already
    asking = open_.join(counts, "token").withColumn("part", F.pmod(F.xxhash64("set_more", "set_key"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = asking.where("other <> block").select("token", "part", F.col("other").alias("cell"), F.lit(True).alias("asks"), *KEY, "first", "words")
    asked = long.join(counts, "token").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("token", "part", F.col("block").alias("cell"), F.lit(False).alias("asks"), *KEY, "first", "words")
    more = asking.unionByName(asked).groupBy("token", "part", "cell").applyInArrow(_later_ones, keys)
    out = materialize(found.union(more).distinct(), "line-dense-later")
    discard(rows, found, open_)
    return out


def similar_to_earlier(docs: DataFrame, classes: DataFrame, counts: np.ndarray) -> DataFrame:
    """set_key and set_more of the classes that have a similar earlier class. docs: doc_id, text, text_key; classes: set_key,
    set_more, first (their earliest line: doc_id, text_key, line)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    # a token is a 32-bit hash here: two that agree by chance only add a pair to verify
    rows = docs.select("text").mapInArrow(_prefixes(shared), "set_key long, size_start long, bits long, more long, prefix array<int>")
    rows = rows.select("set_key", "size_start", "bits", "more", F.posexplode("prefix").alias("i", "token"))
    rows = rows.select("token", "set_key", (F.col("size_start") + F.col("i")).alias("place"), "bits", "more")
    rows = rows.repartition("token").sortWithinPartitions("token", "set_key")
    met = materialize(rows.mapInArrow(_meet, "token int, a long, b long"), "line-met")
    pairs = materialize(met.where("token is null").select("a", "b").distinct(), "line-pairs")
    members = met.where("token is not null").select("token", F.col("a").alias("set_key"))
    ids = pairs.select(F.col("a").alias("set_key")).union(pairs.select(F.col("b").alias("set_key"))).union(members.select("set_key")).distinct()
    sets = _sets_of(docs, classes.join(ids, "set_key").select(*KEY, "first"))
    a, b = (sets.select(F.col("set_key").alias(s), F.struct(*KEY, "first", "words").alias(f"of_{s}")) for s in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("of_a.words", "of_b.words"))
    near = both.where(common * 9 >= (F.size("of_a.words") + F.size("of_b.words")) * 4)
    later = F.when(F.col("of_a.first") > F.col("of_b.first"), F.struct(*(F.col(f"of_a.{k}") for k in KEY))).otherwise(F.struct(*(F.col(f"of_b.{k}") for k in KEY)))
    found = near.select(later.alias("later")).select("later.*")
    dense = _dense_matches(members, sets)
    out = materialize(found.union(dense).distinct(), "line-similar")
    discard(met, pairs, sets, dense)
    return out


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lines (sorted numbers of those removed) and n_near of the documents (doc_id, text, text_key) that lose a line."""
    made = docs.mapInArrow(_lines_and_counts, "doc_id long, text_key long, line int, set_key long, set_more long, bucket int, n long")
    made = materialize(made, "line-lines")
    lines = made.where("bucket is null").drop("bucket", "n")
    first = F.min(F.struct("doc_id", "text_key", "line")).alias("first")
    classes = materialize(lines.groupBy(*KEY).agg(first, F.count("*").alias("copies")), "line-classes")
    similar = similar_to_earlier(docs, classes, _gathered(made.where("bucket is not null").select("bucket", "n")))
    # all lines of a class with a similar earlier class, and all but a class's first
    few = broadcast_if_small(similar, similar.count(), BROADCAST_ROWS)
    state = classes.join(few.withColumn("near", F.lit(True)), KEY, "left").where("near or copies > 1").select(*KEY, "first", F.coalesce("near", F.lit(False)).alias("near"))
    state = materialize(state, "line-state")
    marked = lines.join(broadcast_if_small(state, state.count(), BROADCAST_ROWS), KEY)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("line") == F.col("first.line"))
    gone = marked.where(F.col("near") | ~same).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.count_distinct(F.when(F.col("near") & same, F.col("line"))).alias("n_near"))
    gone = materialize(gone, "line-gone")
    discard(made, classes, similar, state)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines removed from text, and n_lines, n_exact, n_near: its lines, and those removed as equal or as similar to an earlier one."""
    small_batches(docs.sparkSession)
    text_key = F.xxhash64("text")
    gone = removed_lines(docs.select("doc_id", "text", text_key.alias("text_key")))
    own = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    in_id, in_key, mask, near, n_gone = (free_name(c, own) for c in ("gone_id", "gone_key", "gone_mask", "gone_near", "gone_lines"))
    # which lines go, as an array up to the last of them
    runs = F.transform("lines", lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get("lines", i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    flags = gone.select(F.col("doc_id").alias(in_id), F.col("text_key").alias(in_key), F.flatten(runs).alias(mask), F.col("n_near").alias(near), F.size("lines").cast("long").alias(n_gone))
    size = gone.agg(F.count("*"), F.sum(F.array_max("lines") + 1)).first()
    small = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= 16 * BROADCAST_ROWS
    joined = docs.select(*own).join(F.broadcast(flags) if small else flags, F.col("doc_id").eqNullSafe(F.col(in_id)) & (text_key == F.col(in_key)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.get(mask, i), F.lit(False))), "\n")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_near = F.coalesce(near, F.lit(0).cast("long"))
    n_exact = F.coalesce(n_gone, F.lit(0).cast("long")) - n_near
    text = F.when(F.col(mask).isNull(), F.col("text")).otherwise(kept)
    return joined.select(*(text.alias("text") if c == "text" else c for c in own), n_lines.alias("n_lines"), n_exact.alias("n_exact"), n_near.alias("n_near"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
