"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed with a small reader of the wire format: pieces with their scores and types, the model
type, the normaliser's settings and byte fallback. From these a tokenizers pipeline is rebuilt: the normaliser (the
dummy prefix and the metaspace marker), a Unigram model with the pieces' scores or, for a BPE model, merges ranked
by the scores, byte fallback, and the decoder. The model at hand is of type BPE, so unigram scores rank merges there.

Where no piece has a metaspace marker or line break after another character, no piece can reach over a space or line
break, so a text's ids are those of its parts; each task encodes a part once and remembers it. Parts are encoded in
batches by the library's threads. Other models are encoded text by text. A normaliser's character map is read from its trie and applied
to the longest key at each place, as the sentencepiece library does; the tokenizers library's own form goes by grapheme and differs.

Parity with the sentencepiece library is verified on PROBES when a tokenizer is built and, in the tests, on documents.

Defined results: null and empty texts have no tokens, decode to an empty text and count as a true round trip; repeated
rows are encoded alike; an empty table gives an empty result; columns with the names of the results are replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import small_batches, table

MARK = "▁"
#: Threads of one task's batches.
THREADS = 2
#: Remembered parts in one task; all are forgotten when there are more.
REMEMBERED = 600_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PROBES = ["", " ", "a", "Hello world", "  two  spaces  ", "line\nbreak \n end\n", "tab\tand 12,345.67", "日本語 ñandú ß é 🙂", "x" * 300, MARK + "mark", "<s> <unk> </s>", "\x00​"]


@dataclass
class Parsed:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = 1
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields: varints as int, the others as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> Parsed:
    out = Parsed()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            out.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            out.model_type, out.byte_fallback = trainer.get(3, 1), bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            out.charsmap = spec.get(2, b"")
            out.add_dummy_prefix, out.remove_extra_whitespaces, out.escape_whitespaces = (bool(spec.get(i, 1)) for i in (3, 4, 5))
    return out


def character_map(blob: bytes) -> dict[str, str]:
    """The replacements of a normaliser's character map: a double-array trie of UTF-8 keys, whose values are places in a list of texts that end with a zero byte.

    A unit has its label in the lowest byte (bit 31 marks a value), a bit for a value below it (8), and its offset from bit 10 on, times 256 where bit 9 is set."""
    size = struct.unpack("<I", blob[:4])[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    texts = blob[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    every = np.arange(1, 256)
    out = {}
    stack = [(offset(int(units[0])), b"")]
    while stack:
        node, key = stack.pop()
        places = node ^ every
        found = units[np.minimum(places, len(units) - 1)]
        for byte in every[(places < len(units)) & ((found & 0x800000FF) == every)].tolist():
            unit = int(units[node ^ byte])
            below = (node ^ byte) ^ offset(unit)
            if unit >> 8 & 1:
                at = int(units[below]) & 0x7FFFFFFF
                out[(key + bytes([byte])).decode()] = texts[at : texts.index(b"\0", at)].decode()
            stack.append((below, key + bytes([byte])))
    return out


class Normaliser:
    """Replaces the longest key of a character map at each place of a text; user-defined pieces stay as they are."""

    def __init__(self, parsed: Parsed) -> None:
        kept = {piece: piece for piece, _, kind in parsed.pieces if kind == USER}
        self.map = character_map(parsed.charsmap)
        self.users = kept
        self.longest: dict[str, int] = {}
        for key in (*self.map, *kept):
            self.longest[key[0]] = max(len(key), self.longest.get(key[0], 0))
        alone = {k for k in (*self.map, *kept) if len(k) == 1}
        more = [k for k in (*self.map, *kept) if len(k) > 1]
        some = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else "(?!)"
        self.start = re.compile(f"{some(alone)}|{some({k[0] for k in more})}(?={some({k[1] for k in more})})")

    def __call__(self, text: str) -> str:
        out, at = [], 0
        while found := self.start.search(text, at):
            i = found.start()
            out.append(text[at:i])
            sizes = range(min(self.longest[text[i]], len(text) - i), 0, -1)
            key = next((text[i : i + n] for n in sizes if text[i : i + n] in self.users), None) or next((text[i : i + n] for n in sizes if text[i : i + n] in self.map), None)
            out.append(self.users.get(key) or self.map[key] if key else text[i])
            at = i + len(key or " ")
        return "".join(out) + text[at:] if out else text


def build_tokenizer(parsed: Parsed, prefix: bool = True):
    """A tokenizers.Tokenizer with the model's pieces; without prefix it takes parts of a text, not whole ones."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    ids = {piece: i for i, (piece, _, _) in enumerate(parsed.pieces)}
    unknown = next((i for i, p in enumerate(parsed.pieces) if p[2] == UNKNOWN), 0)
    if parsed.model_type == 1:
        model = models.Unigram([(piece, score) for piece, score, _ in parsed.pieces], unknown, parsed.byte_fallback)
    elif parsed.model_type == 2:
        ranked = []
        for i, (piece, score, kind) in enumerate(parsed.pieces):
            if kind == NORMAL:
                halves = [(piece[:j], piece[j:]) for j in range(1, len(piece)) if piece[:j] in ids and piece[j:] in ids]
                ranked += [(-score, i, ids[a], ids[b], (a, b)) for a, b in halves]
        model = models.BPE(ids, [pair for *_, pair in sorted(ranked)], unk_token=parsed.pieces[unknown][0], fuse_unk=True, byte_fallback=parsed.byte_fallback)
    else:
        raise ValueError(f"model type {parsed.model_type}: only unigram (1) and BPE (2) models have scored pieces")
    steps = []
    if parsed.remove_extra_whitespaces and prefix:
        # just spaces go, and at the end metaspace markers too
        steps += [normalizers.Replace(Regex(r"\A +"), ""), normalizers.Replace(Regex(rf"[ {MARK}]+\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if parsed.add_dummy_prefix and prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    made = Tokenizer(model)
    made.normalizer = normalizers.Sequence(steps)
    made.encode_special_tokens = True
    # a model that trims spaces loses all at the beginning, others just the one of the prefix
    leading = 1 << 30 if parsed.remove_extra_whitespaces else 1
    tail = [decoders.Strip(" ", leading, 0)] if parsed.add_dummy_prefix and prefix else []
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return made


def parts_hold(parsed: Parsed) -> bool:
    """Whether texts can be cut before spaces and around line breaks without changing their ids."""
    plain = not parsed.charsmap and not parsed.remove_extra_whitespaces and parsed.add_dummy_prefix
    whole_bytes = parsed.byte_fallback and sum(kind == BYTE for *_, kind in parsed.pieces) == 256
    across = re.compile(f"[^{MARK}]{MARK}|.\n|\n.", re.DOTALL)
    return plain and whole_bytes and not any(kind in (NORMAL, USER) and across.search(piece) for piece, _, kind in parsed.pieces)


_PART = re.compile(f"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n")


class _Parts(dict):
    """Numbers of the parts seen, in the order they came; new ones are listed in fresh."""

    fresh: list[str]

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.fresh.append(part)
        return number


class Codec:
    """Encoder and decoder made from a model's bytes; one serves all tasks of a Python worker."""

    def __init__(self, data: bytes, threads: int = THREADS) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        parsed = parse_model(data)
        self.whole = build_tokenizer(parsed)
        self.normalise = Normaliser(parsed) if parsed.charsmap else None
        self.by_parts = parts_hold(parsed)
        self.part = build_tokenizer(parsed, prefix=False) if self.by_parts else None
        self._forget()

    def _forget(self) -> None:
        self.known = _Parts()
        self.known.fresh = []
        self.flat, self.starts, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _learn(self) -> None:
        """Encode and decode the parts that are new, each once, in one batch of the library."""
        fresh, self.known.fresh = self.known.fresh, []
        if not fresh:
            return
        ids = [e.ids for e in self.part.encode_batch_fast(fresh, add_special_tokens=False)]
        back = self.part.decode_batch(ids, skip_special_tokens=False)
        same = np.array([d == p.replace(MARK, " ") for d, p in zip(back, fresh, strict=True)], dtype=bool)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.same = np.concatenate([self.same, same])

    def encode_checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text and whether they decode to it (metaspace markers read as spaces)."""
        if not self.by_parts:
            plain = list(map(self.normalise, texts)) if self.normalise else texts
            ids = [np.array(e.ids, dtype=np.int32) for e in self.whole.encode_batch_fast(plain, add_special_tokens=False)]
            return ids, [d == t.replace(MARK, " ") for d, t in zip(self.decode(ids), texts, strict=True)]
        if len(self.known) > REMEMBERED:
            self._forget()
        number = self.known.__getitem__
        cut = [list(map(number, _PART.findall(" " + t))) if t else [] for t in texts]
        self._learn()
        n_parts = np.fromiter(map(len, cut), np.int64, len(cut))
        parts = np.fromiter(chain.from_iterable(cut), np.int64, int(n_parts.sum()))
        first, n_ids = self.starts[parts], self.starts[parts + 1] - self.starts[parts]
        ends = np.cumsum(n_ids)
        all_ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n_ids), n_ids)]
        cuts = np.concatenate(([0], np.cumsum(n_parts)))
        bounds = np.concatenate(([0], ends))[cuts]
        wrong = np.concatenate(([0], np.cumsum(~self.same[parts])))[cuts]
        return [all_ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], (np.diff(wrong) == 0).tolist()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_checked(texts)[0]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


@lru_cache(maxsize=2)
def _codec(data: bytes) -> Codec:
    return Codec(data)


def verify_parity(data: bytes, texts: list[str]) -> None:
    """Raise ValueError where ids or decoded texts differ from the sentencepiece library's."""
    import sentencepiece

    reference, codec = sentencepiece.SentencePieceProcessor(model_proto=data), Codec(data)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        expected = reference.encode(text)
        if expected != ids.tolist() or codec.decode([ids])[0] != reference.decode(expected):
            raise ValueError(f"the rebuilt tokenizer differs from sentencepiece on {text[:80]!r}")


def load_model(path: str | None = None) -> bytes:
    """The bytes of a model file, of a public SentencePiece model where no path is given; parity on PROBES is verified."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        data = f.read()
    verify_parity(data, PROBES)
    return data


def _run(shared, keep_ids: bool, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids: list[np.ndarray] = []
            same: list[bool] = []
            a = 0
            while a < len(texts):  # about a megabyte at once
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= 1 << 20):
                    size += len(texts[b])
                    b += 1
                some, right = codec.encode_checked(texts[a:b])
                ids += some
                same += right
                a = b
            columns = {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "roundtrip": pa.array(same, pa.bool_())}
            if digests:
                columns["ids_sha256"] = pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string())
            if keep_ids:
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                columns["ids"] = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32), pa.array(flat))
            names = [n for n in batch.schema.names if n not in ("text", "n_tokens", "roundtrip", "ids", "ids_sha256")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns.values()], [*names, *columns])

    return run


def encode(docs: DataFrame, model: bytes, keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """docs without text, with n_tokens, roundtrip (the ids decode to the text, markers read as spaces), and ids or their sha256 (as 32-bit little-endian)."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.drop("n_tokens", "roundtrip", "ids", "ids_sha256")
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("roundtrip", T.BooleanType())]
    more += [T.StructField("ids_sha256", T.StringType())] * digests + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    schema = T.StructType([*kept.drop("text").schema.fields, *more])
    return kept.mapInArrow(_run(spark.sparkContext.broadcast(model), keep_ids, digests), schema)


def _decoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            ids = [np.asarray(x or [], dtype=np.int32) for x in batch.column("ids").to_pylist()]
            names = [n for n in batch.schema.names if n not in ("ids", "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(codec.decode(ids), pa.string())], [*names, "text"])

    return run


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded without ids and with their text; null ids give an empty text."""
    spark = encoded.sparkSession
    small_batches(spark)
    kept = encoded.drop("text")
    schema = T.StructType([*kept.drop("ids").schema.fields, T.StructField("text", T.StringType())])
    return kept.mapInArrow(_decoder(spark.sparkContext.broadcast(model)), schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, load_model(), keep_ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", F.col("roundtrip"))
