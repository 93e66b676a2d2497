"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes: counts of every byte after contexts of up to ``ORDER`` bytes. With escape method C a byte
seen c times after a context of n occurrences and d distinct successors has probability c / (n + d); an unseen one escapes with
d / (n + d) to the next shorter context, at last to a uniform byte. Counts are frozen after training, so every byte of a text
costs a fixed number of bits and the language with the shortest code wins.

Training counts grams in Spark. Scoring is vectorised: the code length of a gram (context and byte) under every language at once is
a row of a table, found by a hashed lookup from the longest context down.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import packed, small_batches

ORDER = 4
SAMPLE_DOCS = 5_000  # labelled documents of a language that a model is trained on; a hash of doc_id chooses them where there are more
SAMPLE_BYTES = 32 << 20  # and their bytes
TEXT_STEP = 1 << 18
UNKNOWN = "und"
MOST_BITS = 7.5


def held_out(doc_id: str) -> Column:
    """CRC-32 of the id as text leaves 1 when divided by 3; a NULL id is not held out, but not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def grams(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Codes of the (order + 1)-byte grams that end at each byte; before its start a text has ``order`` zero bytes."""
    padded = np.concatenate((np.zeros(order, np.uint64), data.astype(np.uint64)))
    code = np.zeros(len(data), np.uint64)
    for i in range(order + 1):
        code = (code << np.uint64(8)) | padded[i : i + len(data)]
    return code


def train(docs: DataFrame, *, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> PpmModel:
    """Model of the labelled documents that are not held out.

    Uses doc_id, text and lang of rows with neither NULL. Every language has its own quota, about ``sample_docs`` documents and
    ``sample_bytes`` bytes, so a rare one is learned as well as it can be. Counts are aggregated per task and then per (lang, gram), so what
    reaches the driver is the model's own size: the distinct grams of at most ``sample_bytes`` a language. Repeated rows count as often
    as they stand there; an empty table gives a model of no language.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row per language
    rate = {r.lang: min(1.0, sample_docs / r.n, sample_bytes / max(r.bytes, 1)) for r in sizes}
    if any(x < 1 for x in rate.values()):
        share = F.create_map(*[F.lit(v) for lang, x in rate.items() for v in (lang, int((1 << 20) * x))])
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merge(parts):
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in small_batches(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for piece in range(0, len(text), TEXT_STEP):
                    before = np.frombuffer(text[max(0, piece - order) : piece + TEXT_STEP], np.uint8)
                    code = grams(before, order)[min(piece, order) :]
                    parts = held.setdefault(lang, [])
                    parts.append((code, np.ones(len(code))))
                    if sum(len(p[0]) for p in parts[1:]) > 4 * TEXT_STEP:
                        held[lang] = [merge(parts)]
        for lang, parts in held.items():
            codes, counts = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    at = {lang: i for i, lang in enumerate(langs)}
    return PpmModel(langs, np.array([at[x] for x in found["lang"].to_pylist()], np.int64), found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy(), order)


class PpmModel:
    """Frozen statistics of all languages as tables of code lengths.

    ``level[k]``: gram codes of context length k, seen in any language, and per language the bits of the gram; where a language
    has not seen the gram, the bits of its escapes down to what it has seen. ``escape[k]``: contexts of length k, and per language
    the bits of the escape (0 where the language does not know the context).
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int):
        self.langs, self.order = langs, order
        size = len(langs)
        self.level: list[tuple[np.ndarray, np.ndarray]] = []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(order + 1):
            codes, row = np.unique(gram & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.zeros((len(codes), size))
            np.add.at(counts, (row, lang), n)
            contexts, parent = np.unique(codes >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, parent, counts)
            np.add.at(distinct, parent, counts > 0)
            room = np.where(total > 0, total + distinct, 1.0)
            escape = np.where(total > 0, -np.log2(np.where(total > 0, distinct, 1.0) / room), 0.0)
            seen = counts > 0
            shorter = self.bits(codes, k - 1)
            bits = np.where(seen, -np.log2(np.where(seen, counts, 1.0) / room[parent]), escape[parent] + shorter)
            self.level.append(_index(codes, bits))
            self.escape.append(_index(contexts, escape))

    def bits(self, codes: np.ndarray, k: int | None = None) -> np.ndarray:
        """Bits of each gram's last byte under every language, contexts of up to k bytes."""
        k = self.order if k is None else k
        if k < 0:
            return np.full((len(codes), len(self.langs)), 8.0)
        codes = codes & np.uint64((1 << 8 * (k + 1)) - 1)
        row = _find(self.level[k], codes)
        out = self.level[k][2].take(row, axis=0)
        missing = np.flatnonzero(row == 0)
        if len(missing):
            rest = codes[missing]
            down = self.escape[k][2].take(_find(self.escape[k], rest >> np.uint64(8)), axis=0)
            out[missing] = down + self.bits(rest, k - 1)
        return out

    def code_length(self, text: bytes) -> np.ndarray:
        """Bits of the whole text under every language."""
        total = np.zeros(len(self.langs))
        for piece in range(0, len(text), TEXT_STEP):
            data = np.frombuffer(text[max(0, piece - self.order) : piece + TEXT_STEP], np.uint8)
            total += self.bits(grams(data, self.order)[min(piece, self.order) :]).sum(axis=0, dtype=np.float64)
        return total


def _index(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Open-addressing hash table of codes to row numbers; row 0 stands for "not there"."""
    shift = 64 - max(4, int(np.ceil(np.log2(2 * len(codes) + 1))))
    slots = 1 << (64 - shift)
    keys, places = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
    left, home = np.arange(len(codes)), _home(codes, shift)
    while len(left):
        free = places[home[left]] == 0
        trying, first = np.unique(home[left[free]], return_index=True)
        set_ = left[free][first]
        keys[trying], places[trying] = codes[set_], set_ + 1
        left = left[places[home[left]] != left + 1]
        home[left] = (home[left] + 1) & (slots - 1)
    return keys, places, np.concatenate((np.zeros((1, rows.shape[1])), rows)).astype(np.float32), shift


def _home(codes: np.ndarray, shift: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)


def _find(index: tuple[np.ndarray, np.ndarray, np.ndarray, int], codes: np.ndarray) -> np.ndarray:
    keys, places, _, shift = index
    home = _home(codes, shift)
    row = places[home]
    open_ = np.flatnonzero((row > 0) & (keys[home] != codes))
    while len(open_):  # probe on where another code sits
        home[open_] = (home[open_] + 1) & (len(keys) - 1)
        row[open_] = places[home[open_]]
        open_ = open_[(row[open_] > 0) & (keys[home[open_]] != codes[open_])]
    return row


def predict(docs: DataFrame, model: PpmModel) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and bits_per_byte; only the column ``text`` is looked at.

    ``score`` is the best language's share if every language weighs 2^-(code length); ties go to the first name. NULL texts,
    texts without a letter, and all texts under a model of no language are ``und`` with score 0 and NULL bits. Columns named
    like the added ones are replaced. Rows are predicted one by one, repeated rows alike; a very long text is scored in pieces of
    ``TEXT_STEP`` bytes; an empty table gives an empty one.
    """
    added = ("lang_pred", "score", "bits_per_byte")
    kept = [c for c in docs.columns if c not in added]
    at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was trained on
    schema = T.StructType([docs.schema[c] for c in kept])
    for name, kind in zip(added, (T.StringType(), T.DoubleType(), T.DoubleType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, ppm = regex.compile(r"\p{L}"), shared.value
        for batch in small_batches(batches, at):
            names, scores, rates = [], [], []
            for text in batch.column(at).to_pylist():
                if not text or not ppm.langs or not letter.search(text):
                    names.append(UNKNOWN), scores.append(0.0), rates.append(None)
                    continue
                data = text.encode()
                bits = ppm.code_length(data)
                best = int(bits.argmin())
                names.append(ppm.langs[best])
                scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
                rates.append(float(bits[best] / len(data)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [*kept, *added])

    return docs.select(*kept).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: PpmModel, *, most_bits: float = MOST_BITS) -> DataFrame:
    """Documents in a language the model knows, with their columns as they are but ``lang`` filled where it is NULL.

    Rejected are those without a letter and those whose code is longer than ``most_bits`` a byte, which is as long as text that no
    language predicts at all. An empty model rejects everything, for it knows no language.
    """
    found = predict(packed(docs).select("whole", "text"), model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") <= most_bits))
    column = lambda c: F.coalesce(F.col("whole").getField(c), "lang_pred") if c == "lang" else F.col("whole").getField(c)
    return found.select(*[column(c).alias(c) for c in docs.columns])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from its labelled documents that are not held out."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")
