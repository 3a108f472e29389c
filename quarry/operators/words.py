"""Words of a dictionary in texts: many patterns at once (J13) and segmentation of texts without spaces (X14), with dictionaries induced from a corpus.

The automaton or dictionary is a list that its caller bounds; it goes to all tasks once. Texts are handled one at a time and whole. A null text counts as empty."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import small_batches

#: Characters of a word that segment() looks for, and the log probability of a character that no word has, less than any word's.
LONGEST, UNKNOWN = 12, -25.0


def find_words(df: DataFrame, text: str, words: list[str], out: str = "words") -> DataFrame:
    """df with the words of a list that its text contains, as an array of structs (word, n) in order of the words; occurrences may overlap.

    One pass over a text finds all words, however many there are. Empty words are left out."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(sorted({w for w in words if w}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for i, w in enumerate(shared.value):
            machine.add_word(w, i)
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            found = []
            for value in batch.column(text).to_pylist():
                counts: dict[int, int] = {}
                if value and len(machine):
                    for _, i in machine.iter(value):
                        counts[i] = counts.get(i, 0) + 1
                found.append([{"word": shared.value[i], "n": n} for i, n in sorted(counts.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))], [*batch.schema.names, out])

    kept = df.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, `{out}` array<struct<word:string,n:bigint>>")


def best_split(text: str, words: dict[str, float], longest: int) -> list[str]:
    """The split of a text into words, or single characters, with the greatest sum of log probabilities; of equal ones the one whose last words are longest."""
    best, size = [0.0], [0]
    for end in range(1, len(text) + 1):
        value, n = max((best[end - k] + words.get(text[end - k : end], UNKNOWN if k == 1 else -math.inf), k) for k in range(1, min(longest, end) + 1))
        best.append(value)
        size.append(n)
    out, end = [], len(text)
    while end:
        out.append(text[end - size[end] : end])
        end -= size[end]
    return out[::-1]


def segment(df: DataFrame, text: str, words: dict[str, int], out: str = "words") -> DataFrame:
    """df with its text cut into the likeliest words of a dictionary of counts, as an array; white space ends a word."""
    small_batches(df.sparkSession)
    total = sum(words.values()) or 1
    longest = max((len(w) for w in words), default=1)
    shared = df.sparkSession.sparkContext.broadcast({w: math.log(n / total) for w, n in words.items() if n > 0})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [[w for part in (value or "").split() for w in best_split(part, shared.value, longest)] for value in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.list_(pa.string()))], [*batch.schema.names, out])

    kept = df.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, `{out}` array<string>")


def induced_words(texts: DataFrame, text: Column, most: int = 4, least: int = 5, cohesion: float = 1.0, freedom: float = 0.5) -> DataFrame:
    """(word, n, cohesion, freedom): runs of 2 to most characters that hang together and stand freely, from texts without spaces.

    cohesion is the least log ratio of a run's probability to that of two parts of it; freedom the smaller of the entropies of the characters before and after it.
    Runs are counted with their neighbours in one grouping; letters alone are parts, not words. A run of a document counts where it lies, so copies count again."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")
    parts = texts.select(F.explode(F.split(clean, " ")).alias("part")).where("part <> ''")
    places = F.sequence(F.lit(1), F.length("part"))
    runs = parts.select("part", F.explode(places).alias("at")).select("part", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.length("part") - F.col("at") + 1))).alias("size"))
    runs = runs.select(F.substring("part", F.col("at"), F.col("size")).alias("run"), F.when(F.col("at") > 1, F.substring("part", F.col("at") - 1, F.lit(1))).otherwise("").alias("before"), F.substring("part", F.col("at") + F.col("size"), F.lit(1)).alias("after"))
    cells = runs.groupBy("run", "before", "after").agg(F.count("*").alias("n"))
    counts = cells.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    total = cells.where(F.length("run") == 1).agg(F.sum("n").alias("total"))

    def entropy(side: str) -> DataFrame:
        each = cells.where(F.length("run") > 1).groupBy("run", side).agg(F.sum("n").alias("m"))
        return each.groupBy("run").agg((F.ln(F.sum("m")) - F.sum(F.col("m") * F.ln("m")) / F.sum("m")).alias(f"free_{side}"))

    cuts = counts.where(F.length("run") > 1).select("run", "n", F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("k"))
    cuts = cuts.select("run", "n", F.substring("run", F.lit(1), F.col("k")).alias("left"), F.substring("run", F.col("k") + 1, F.length("run")).alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(counts.select(F.col("run").alias(side), F.col("n").alias(f"n_{side}")), side)
    ratio = F.ln(F.col("n").cast("double") * F.col("total") / (F.col("n_left").cast("double") * F.col("n_right")))
    tight = cuts.join(F.broadcast(total)).groupBy("run").agg(F.first("n").alias("n"), F.min(ratio).alias("cohesion")).where(F.col("cohesion") >= cohesion)
    free = tight.join(entropy("before"), "run").join(entropy("after"), "run")
    out = free.select(F.col("run").alias("word"), "n", F.round("cohesion", 6).alias("cohesion"), F.round(F.least("free_before", "free_after"), 6).alias("freedom"))
    return out.where(F.col("freedom") >= freedom)
