"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank vocabulary.

Every token's bytes are mapped to printable characters, one character a byte; the pieces get score -rank, so sentencepiece's
merges (best score first, then leftmost) are the merges by rank. The model has identity normalisation, no added prefix and no
white-space escapes. Text is cut into pre-tokens by the vocabulary's pattern, each pre-token is encoded on its own; decoding looks
ids up in the inverse mapping.
"""
from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import small_batches

CACHE_BYTES = 32 << 20  # what a task remembers of encoded chunks, about; beyond it the memory is emptied, results do not change
CACHE_CHARS = 64  # longer chunks are never remembered
ENTRY_BYTES = 200  # two strings and a place in a dictionary, beside their characters


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file: base64 token, space, rank. It is a fixed vocabulary, read once on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_letters() -> list[str]:
    """One printable character a byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece i is the token of rank i; the piece after the last is <unk>, which no text reaches."""
    letters = byte_letters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold every single byte")
    normal, unknown = 1, 2
    piece = lambda name, score, kind: _field(1, _field(1, name.encode()) + _field(2, float(score)) + _field(3, kind))
    pieces = [piece("".join(letters[b] for b in token), -rank, normal) for rank, token in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    model_type, vocab_size, unk, bos, eos, pad = 3, 4, 40, 41, 42, 43
    none = (1 << 64) - 1  # -1
    trainer = _field(model_type, 2) + _field(vocab_size, len(pieces)) + _field(unk, len(tokens)) + _field(bos, none) + _field(eos, none) + _field(pad, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def compile_pattern(pattern: str):
    """The pre-token pattern with white space as Unicode defines it (Python's also counts U+001C to U+001F)."""
    import regex

    # inside a class the property needs no brackets of its own
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Codec:
    """Encoder and decoder of one worker; remembers encoded chunks."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = compile_pattern(pattern)
        self.mixed = compile_pattern(r" \s|\s ")
        letters = byte_letters()
        self.table = {b: letters[b] for b in range(256)}
        back = {c: b for b, c in enumerate(letters)}
        n = self.model.get_piece_size() - 1
        self.bytes_of = {str(i): bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(n)}
        self.known: dict[str, str] = {}  # chunk after a space: its ids
        self.first: dict[str, str] = {}  # chunk as it stands: its ids
        self.held = 0  # bytes of both, about

    def learn(self, new: set[str], prefix: str, known: dict[str, str]) -> None:
        gc.disable()  # many small lists at once, none in a cycle
        split = [(c, self.pieces.findall(prefix + c)) for c in new]
        pieces = list({p for _, found in split for p in found})
        ids = self.model.encode([p.encode().decode("latin-1").translate(self.table) for p in pieces], num_threads=1)
        by_piece = {p: " ".join(map(str, some)) for p, some in zip(pieces, ids)}
        known.update((c, " ".join([by_piece[p] for p in found])) for c, found in split)
        del split, by_piece, ids
        gc.enable()

    def encode(self, texts: list[str]) -> list[str]:
        """Ids in decimal, joined by one space, of each text; pre-tokens that are new to the worker are encoded in one call.

        Where no space stands beside other white space, every pre-token lies between two spaces or starts with one, so chunks
        cut at spaces have the pre-tokens that the whole text has. Other texts are cut into pre-tokens as they are.
        """
        cut = []
        for text in texts:
            if self.mixed.search(text):
                cut.append((self.pieces.findall(text), []))
            else:
                head, *rest = text.split(" ")
                cut.append(([head] if head else [], rest))
        views = [self.view(set().union(*[c[at] for c in cut]), prefix, known) for known, prefix, at in ((self.first, "", 0), (self.known, " ", 1))]
        first, known = (view.__getitem__ for view in views)
        return [" ".join([*map(first, head), *map(known, rest)]) for head, rest in cut]

    def view(self, wanted: set[str], prefix: str, known: dict[str, str]) -> dict[str, str]:
        """Ids of the wanted chunks. What is new and short is remembered, as long as the bound allows."""
        new = wanted.difference(known)
        short = {c for c in new if len(c) <= CACHE_CHARS}
        out = {c: known[c] for c in wanted - new}
        for some, keep in ((short, True), (new - short, False)):
            if not some:
                continue
            learned: dict[str, str] = {}
            self.learn(some, prefix, learned)
            out.update(learned)
            if keep:
                size = sum(ENTRY_BYTES + 2 * len(c) + len(ids) for c, ids in learned.items())
                if self.held + size > CACHE_BYTES:
                    self.first.clear(), self.known.clear()
                    self.held = 0
                if size <= CACHE_BYTES:
                    known.update(learned)
                    self.held += size
        return out

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


def bpe_round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids: n_tokens, ids_sha256, decoded_sha256 beside all columns but text.

    NULL and empty texts have no ids and decode to no bytes; both digests are then those of the empty string. ``with_ids`` adds
    ``ids`` (array<int>). Columns named like the added ones are replaced. Every row is encoded by itself; there is no shuffle, so
    repeated rows, ties and hot groups change nothing, and an empty table gives an empty one. A very long text is held once with its
    ids; what a task remembers of chunks is bounded by ``CACHE_BYTES`` and given back, with the model, when the task ends.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((serialise_model(ranks), pattern))  # a fixed vocabulary of about a megabyte
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    schema = T.StructType([docs.schema[c] for c in kept]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in small_batches(batches, len(kept)):
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for ids in codec.encode([text or "" for text in batch.column(len(kept)).to_pylist()]):
                decoded = codec.decode(ids)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha(ids.encode()))
                text_sha.append(sha(decoded))
                if with_ids:
                    all_ids.append(np.array(ids.split(), np.int32))
            columns = [*batch.columns[: len(kept)], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        del codec
        gc.collect()
        pa.default_memory_pool().release_unused()

    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
