"""Secrets by dictionary-primed zstandard novelty against the surrounding text and a dictionary of identifiers.

Base spans of three kinds (assign, access, hex) come from fixed patterns and length checks and always stay. The method looks at further
candidates: runs of key characters of LEAST_CHARS or more that follow a word of a sensitive context (`bearer`, `credential`,
`private key` and the like) within CONTEXT characters, or that are the password of a URL. A candidate is compressed by zstandard
primed with the dictionary, and again primed with the AROUND characters on either side of it: the bytes it takes beyond an empty frame are what it adds to
what is known. Paths, identifiers and repeated placeholders take few, random characters as many as the same characters shuffled. A candidate that both times takes
NOVEL bytes a character and AS_MIXED of what its shuffled characters take, and that overlaps no base span, is reported as a span of kind `novel`. Cases are not told apart
in this.

The dictionary is the commonest identifiers of all texts, counted in tasks and summed in Spark, up to DICTIONARY_BYTES with the
commonest last, where zstandard finds them with the shortest offsets. Only runs of key characters without a digit are counted and base spans are
not, so that a secret of many copies doesn't become a known word. The dictionary is the only thing that reaches the driver, and is of fixed size.

Texts are handled whole, one at a time; a candidate is compressed with at most 2 * AROUND characters about it, so the work grows with the
text and its candidates. Offsets count code points, ends are exclusive. Defined results: a null text counts as empty; an empty or clean text
has counts of 0, the sha256 of the empty string and empty spans; repeated rows give the same spans; null doc_ids are carried; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, table

KINDS = ["assign", "access", "hex"]
NOVELTY = "novel"
#: The fixed patterns, runs that are too short left out: nothing shorter could match within a longer run.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Words that make a context sensitive, and the password of a URL.
CONTEXTS = re.compile(r"(?:passwords?|passwd|passphrase|pwd|secrets?|tokens?|api[ _-]?keys?|access[ _-]?keys?|private[ _-]?keys?|secret[ _-]?keys?|credentials?|bearer|authori[sz]ation|auth|cookie|session[ _-]?id|signature)(?![A-Za-z])|://[^\s/:@]{1,64}:(?=[^\s/@]+@)", re.ASCII | re.IGNORECASE)
RUN = re.compile(r"[A-Za-z0-9+/_][A-Za-z0-9+/_=~-]*")
IDENTIFIER = re.compile(r"[A-Za-z]+")
#: Characters after a sensitive word in which a candidate begins, characters on either side that it is measured against, and its length at least.
CONTEXT, AROUND, LEAST_CHARS = 48, 256, 16
#: Marginal bytes for each character (a random hexadecimal one has 0.5), and share of the marginal bytes of the same characters in random order,
#: from which on a candidate is reported.
NOVEL, AS_MIXED = 0.5, 0.9
DICTIONARY_BYTES, LEVEL, LEAD = 1 << 16, 12, 64
#: Letters of an identifier of the dictionary, and different ones that a task counts before it passes its counts on.
IDENTIFIER_CHARS, HELD = (4, 32), 200_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of key characters after a sensitive word, with a digit or a change from small to capital letters inside."""
    out: list[tuple[int, int]] = []
    end = 0
    for word in CONTEXTS.finditer(text):
        at = max(word.end(), end)
        while run := RUN.search(text, at, word.end() + CONTEXT):
            # the run that begins in the window goes on beyond it
            start = run.start()
            end = at = RUN.match(text, start).end()
            if end - start >= LEAST_CHARS and re.search(r"[A-Za-z]", text[start:end]) and re.search(r"[0-9]|[a-z][A-Z]", text[start:end]):
                out.append((start, end))
    return out


class Novelty:
    """Marginal compressed sizes by zstandard, primed with a dictionary or with the surrounding text.

    A candidate is compressed behind the last characters of what is primed, so that the frame is a compressed one with or without it."""

    def __init__(self, dictionary: bytes) -> None:
        self.known = self._primed(dictionary, precompute=True)

    @staticmethod
    def _primed(content: bytes, precompute: bool = False) -> tuple[zstandard.ZstdCompressor, bytes, int]:
        primed = {}
        if len(content) >= 8:  # the library takes no shorter dictionary
            primed["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if precompute:
                primed["dict_data"].precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_dict_id=False, write_content_size=False, **primed)
        return compressor, content[-LEAD:], len(compressor.compress(content[-LEAD:]))

    def found(self, text: str, start: int, end: int) -> bool:
        """Whether text[start:end] adds as many bytes as its characters in any order, to the dictionary and to the text around it alike."""
        own = text[start:end].lower().encode()
        around = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).lower().encode(errors="replace")
        mixed = bytes(random.Random(zlib.crc32(own)).sample(own, len(own)))
        for compressor, lead, alone in (self.known, self._primed(around)):
            size = len(compressor.compress(lead + own)) - alone
            if size < NOVEL * len(own) or size < AS_MIXED * (len(compressor.compress(lead + mixed)) - alone):
                return False
        return True


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) as (start, kind, end)."""
    base = base_spans(text)
    # base spans of different kinds may overlap: those before a candidate are known by their greatest end
    starts = np.array([s for s, _, _ in base], dtype=np.int64)
    ends = np.maximum.accumulate(np.array([e for *_, e in base], dtype=np.int64)) if base else starts
    added = []
    for start, end in candidates(text):
        before = int(np.searchsorted(starts, end, "left"))
        if (not before or ends[before - 1] <= start) and novelty.found(text, start, end):
            added.append((start, len(KINDS), end))
    return base, added


def identifiers(docs: DataFrame) -> DataFrame:
    """(word, n): how often each identifier occurs in all texts of docs, outside base spans and runs with digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, parts = 0, []
                for start, _, end in base_spans(text):
                    parts.append(text[at : max(at, start)])
                    at = max(at, end)
                clean = " ".join([*parts, text[at:]]) if parts else text
                if any(map(clean.__contains__, "0123456789")):
                    clean = re.sub(r"[A-Za-z0-9+/_=~-]*[0-9][A-Za-z0-9+/_=~-]*", " ", clean)
                low, high = IDENTIFIER_CHARS
                held.update(w for w in IDENTIFIER.findall(clean.lower()) if low <= len(w) <= high)
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        yield out()

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame) -> bytes:
    """The commonest identifiers of all texts, ties by word, the commonest last, in DICTIONARY_BYTES bytes at most."""
    low = IDENTIFIER_CHARS[0]
    best = identifiers(docs).where("n > 1").orderBy(F.desc("n"), "word").limit(DICTIONARY_BYTES // (low + 1)).collect()
    words, room = [], DICTIONARY_BYTES
    for r in best:
        if room < len(r["word"]) + 1:
            break
        words.append(r["word"])
        room -= len(r["word"]) + 1
    return " ".join(reversed(words)).encode()


def find_secrets(docs: DataFrame, known: bytes | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans (all), n_added of each row of docs (doc_id, text).

    known is the dictionary; without it that of docs is made."""
    small_batches(docs.sparkSession)
    primed = dictionary(docs) if known is None else known
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*KINDS, NOVELTY]

    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed)
        for batch in batches:
            counts, hashes, spans, added = np.zeros((len(batch), len(KINDS)), dtype=np.int64), [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                base, more = scan(text, novelty)
                for _, k, _ in base:
                    counts[i, k] += 1
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + more)))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k].copy()) for k in range(len(KINDS))), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
