"""Byte-pair encoding through a table of distinct words, and decoding through an id-to-piece join.

All distinct words of the corpus meet in one table, where every word is encoded once. A bounded number of
the words that most tasks hold is broadcast with its ids; texts become sequences of numbers of such words,
with the other words listed in order. Texts are dealt into blocks in this form, which is several times
smaller. Each block lists its other words, these are joined to their ids in the table, go back to the
block and are put in by position. So the size of the vocabulary does not matter: a task holds one block,
the words of that block and the bounded list. The block of a row follows from its id and text; where that leaves
a block too large (copies of rows), rows are written with a block that also counts their place in the table.

The text rules are those of the tokenizer file: special tokens are cut out first, then NFC, lower case,
words by a pattern, white space dropped. A file without a decoder decodes to its pieces joined by spaces.

Cases: a null or empty text has no ids and decodes to an empty text; repeated rows give equal rows; other
columns pass through, except those with the name of a result; a row without id is a row like others.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from brinewatch.llm.tables import arrow_batches, fresh
from brinewatch.session import checkpointed

#: Bytes of text in one block.
BLOCK_BYTES = 4 << 20
#: Rows of one block at most, about, where texts are short.
BLOCK_ROWS = 200_000
#: Words that are broadcast with their ids at most, and their greatest length; the others are joined.
MOST_FREQUENT, LONGEST = 300_000, 64
#: Distinct words a task lists before it starts a new list.
LISTED = 500_000
#: The word pattern of the tokenizer file.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Outside Latin, Greek, Cyrillic, general punctuation and currency signs.
RARE = r"[^\x00-\u052f\u2000-\u206e\u20a0-\u20bf]"

RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()),
    ]
)


class WordSplitter:
    """Cuts a text into the words that are encoded one by one, special tokens being words of their own.

    Texts in characters on which Unicode versions agree are cut by our own pattern, which is much faster;
    the others by the tokenizer file's rules themselves.
    """

    def __init__(self, tokenizer_json: str):
        special = list(special_tokens(tokenizer_json))
        self.names = set(special)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.word = regex.compile(WORD)
        self.rare = regex.compile(RARE)
        parts = json.loads(tokenizer_json)
        parts |= {"added_tokens": [], "truncation": None, "padding": None}
        # Only the rules for cutting are needed here, not the vocabulary.
        parts["model"] = {"type": "BPE", "vocab": {}, "merges": []}
        parts["pre_tokenizer"] = parts["pre_tokenizer"]["pretokenizers"][0]
        self.rules = Tokenizer.from_str(json.dumps(parts))

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return [w for p in parts for w in ([p] if p in self.names else self._plain(p))]

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if self.rare.search(text):
                text = self.rules.normalizer.normalize_str(text)
                return [w for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(text)]
            # Capital sigma has one lower-case form here, wherever it stands.
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return self.word.findall(text.lower())


def special_tokens(tokenizer_json: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.loads(tokenizer_json)["added_tokens"]}


@functools.lru_cache(maxsize=1)
def word_tokenizer(tokenizer_json: str) -> Tokenizer:
    """The file's model for single words that are already normalised and cut."""
    parts = json.loads(tokenizer_json)
    parts |= {"added_tokens": [], "normalizer": None, "truncation": None, "padding": None}
    parts["pre_tokenizer"] = {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False,
    }
    return Tokenizer.from_str(json.dumps(parts))


def pieces(tokenizer_json: str) -> dict[int, str]:
    vocabulary = json.loads(tokenizer_json)["model"]["vocab"]
    return {i: piece for piece, i in [*vocabulary.items(), *special_tokens(tokenizer_json).items()]}


def word_table(docs: DataFrame, tokenizer_json: str, text: str) -> DataFrame:
    """Every distinct ``word`` and the number ``n`` of tasks' lists that hold it; written, as it is used twice."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = WordSplitter(shared.value), set()
        for batch in batches:
            for value in batch.column(0):
                seen.update(split(value.as_py() or ""))
                if len(seen) > LISTED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["word"])
                    seen = set()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["word"])

    words = docs.select(F.col(text).cast("string")).mapInArrow(listed, "word string")
    return checkpointed(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def encoded(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """``word`` rows with their ``ids``."""
    shared = words.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = special_tokens(shared.value)
        tokenizer = word_tokenizer(shared.value)
        for batch in batches:
            listed = batch.column("word").to_pylist()
            ids = [e.ids for e in tokenizer.encode_batch(listed, add_special_tokens=False)]
            ids = [[special[w]] if w in special else i for w, i in zip(listed, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return words.select("word").mapInArrow(encode, "word string, ids array<int>")


class WordIds:
    """Numbered words and their ids, one list behind the other."""

    def __init__(self, words: list[str], ids: pa.ListArray):
        self.words = words
        self.length = np.asarray(ids.value_lengths()).astype(np.int64)
        self.flat = np.asarray(ids.flatten()).astype(np.dtype("<u4"))

    def numbers(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}


def frequent_words(table: DataFrame, tokenizer_json: str, most: int) -> tuple[WordIds, int]:
    """The words in most tasks' lists, ``most`` at most, and the least ``n`` they have."""
    short = table.where(F.length("word") <= LONGEST)
    levels = short.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))
    total, least = 0, 2**62
    for level in levels.toLocalIterator():
        total += level["words"]
        if total > most:
            break
        least = level["n"]
    chosen = short.where(F.col("n") >= least)
    # Bounded in number and length. Shorter words are the more frequent ones: small numbers pack well.
    order = chosen.select("word", "n").toArrow()
    ids = encoded(chosen, tokenizer_json).toArrow()
    listed = dict(zip(ids.column("word").to_pylist(), ids.column("ids").to_pylist()))
    ranked = sorted(zip(order.column("n").to_pylist(), order.column("word").to_pylist()), key=lambda x: (-x[0], len(x[1]), x[1]))
    words = [w for _, w in ranked]
    return WordIds(words, pa.array([listed[w] for w in words], pa.list_(pa.int32()))), least


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24, byte by byte, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T)
    parts = [_zstd().compress(plane.tobytes()) for plane in planes]
    return struct.pack("<4I", len(numbers), *map(len, parts)) + b"".join(parts)


def unpack(data: bytes) -> np.ndarray:
    count, *sizes = struct.unpack_from("<4I", data)
    out, at = np.zeros((count, 4), np.uint8), 16
    for plane, size in enumerate(sizes):
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(count, 1))
        out[:, plane] = np.frombuffer(raw, np.uint8)
        at += size
    return out.reshape(-1).view("<u4").astype(np.int64)


@functools.lru_cache(maxsize=1)
def _zstd() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


def bpe_round_trip(
    docs: DataFrame, tokenizer_json: str, text: str = "text", id_col: str = "doc_id",
    block_bytes: int = BLOCK_BYTES, most_frequent: int = MOST_FREQUENT,
) -> DataFrame:
    """``docs`` without their ``text``, with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``."""
    spark = docs.sparkSession
    arrow_batches(spark, 1000)
    kept = [f for f in docs.schema if f.name not in (*RESULT.names, text)]
    block, packed, others = (fresh(docs, c) for c in ("block", "packed", "others"))
    table = word_table(docs, tokenizer_json, text)
    frequent, least = frequent_words(table, tokenizer_json, most_frequent)
    shared = spark.sparkContext.broadcast((tokenizer_json, frequent))
    source = docs.select(*(f.name for f in kept), F.col(text).cast("string").alias(text))
    size, key = F.coalesce(F.octet_length(text), F.lit(0)), F.xxhash64(F.col(id_col), F.col(text).cast("string"))
    blocks = (docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0) // block_bytes + 1
    placed = source.withColumn(block, F.pmod(key, F.lit(blocks)))
    held = placed.groupBy(block).agg(F.count(F.lit(1)).alias("n"), (F.sum(size) - F.max(size)).alias("size"))
    # A single long text is a block of its own accord; rows with short or no texts count as well.
    if not held.where((F.col("size") > 2 * block_bytes) | (F.col("n") > BLOCK_ROWS)).isEmpty():
        total = docs.count()
        blocks = max(blocks, total // (BLOCK_ROWS // 2) + 1)
        spread = F.xxhash64(key, F.monotonically_increasing_id())
        placed = checkpointed(source.withColumn(block, F.pmod(spread, F.lit(blocks))))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = WordSplitter(shared.value[0]), shared.value[1].numbers()
        other = len(known)
        for batch in batches:
            codes, rest = [], []
            for value in batch.column(text):
                words = split(value.as_py() or "")
                numbers = np.array([known.get(w, other) for w in words], np.int64)
                codes.append(pack(numbers))
                rest.append([words[i] for i in np.flatnonzero(numbers == other)])
            columns = [batch.column(f.name) for f in kept] + [batch.column(block)]
            columns += [pa.array(codes, pa.binary()), pa.array(rest, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), block, packed, others])

    extra = [T.StructField(block, T.LongType()), T.StructField(packed, T.BinaryType())]
    extra.append(T.StructField(others, T.ArrayType(T.StringType())))
    # Both readers below take all columns, so one exchange feeds them.
    dealt = placed.mapInArrow(number, T.StructType([*kept, *extra])).repartition(block)

    def list_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set] = {}
        for batch in batches:
            for b, words in zip(batch.column(block).to_pylist(), batch.column(others).to_pylist()):
                seen.setdefault(b, set()).update(words)
        for b, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(words), pa.int64()), pa.array(list(words), pa.string())], ["b", "word"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        tokenizer, base = shared.value
        names = _piece_array(tokenizer)
        own = WordIds(right.column("word").to_pylist(), right.column("ids").combine_chunks())
        place = {w: i + len(base.words) for i, w in enumerate(own.words)}
        flat, length = np.concatenate([base.flat, own.flat]), np.concatenate([base.length, own.length])
        start = np.cumsum(length) - length
        ids, decoded = [], []
        for data, rest in zip(left.column(packed), left.column(others)):
            numbers = unpack(data.as_py())
            numbers[numbers == len(base.words)] = [place[w] for w in rest.as_py()]
            sizes = length[numbers]
            inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = flat[np.repeat(start[numbers], sizes) + inner]
            ids.append(found.tobytes())
            decoded.append(" ".join(names[found]))
        counts = pa.array([len(i) // 4 for i in ids], pa.int64())
        return pa.Table.from_arrays(
            [*(left.column(f.name) for f in kept), counts, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
            [*(f.name for f in kept), *RESULT.names],
        )

    rare = encoded(table.where((F.col("n") < least) | (F.length("word") > LONGEST)), tokenizer_json)
    back = dealt.mapInArrow(list_others, "b bigint, word string").join(rare, "word").select("b", "word", "ids")
    return (
        dealt.groupBy(block).cogroup(back.groupBy("b")).applyInArrow(assemble, T.StructType([*kept, *RESULT.fields]))
    )


@functools.lru_cache(maxsize=1)
def _piece_array(tokenizer_json: str) -> np.ndarray:
    """The id-to-piece table of the vocabulary, which is of fixed size."""
    table = pieces(tokenizer_json)
    out = np.full(max(table) + 1, "", dtype=object)
    out[list(table)] = list(table.values())
    return out


def bpe_report(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """One row per document: number of tokens, digests of the ids and of the decoded text."""
    done = bpe_round_trip(docs.select("doc_id", "text"), tokenizer_json)
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
