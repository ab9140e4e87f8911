"""Byte-level BPE encoding and decoding by a global shuffle of distinct words (free style).

Each block of documents is cut into pre-tokens; a pre-token's position is kept as its number in the
block's word list. The block's distinct words are dealt by word into buckets, one packed row for
each bucket, so that equal words of all blocks meet in a task and each is encoded once; the ids go
back to their block and are put in place by position. The number of buckets follows the number of
input partitions up to MOST_BUCKETS, so that the rows shuffled grow in proportion to the blocks; what a
task keeps of a bucket's words is bounded by MOST_KNOWN.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import small_batches, tidy

BLOCK_CHARS = 16_000_000
MOST_BUCKETS = 4096
MOST_KNOWN = 1_000_000  # words of a bucket whose ids a task keeps; beyond, it starts anew
_LONG = 48  # bytes of a word from which merges are kept in a heap
_NONE = 1 << 31  # above every rank
_BITS_AT_ONCE = 1 << 17
_ROWS = 500
_PLACED_AT_ONCE = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a .tiktoken vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: a word that is a token is that token; else, of all neighbouring parts that
    together are a token, those of the lowest rank, the leftmost first, are merged for as long as there are any."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) >= _LONG:
        return _encode_long(word, ranks)
    parts = [word[k : k + 1] for k in range(len(word))]
    get = ranks.get
    pairs = [get(word[k : k + 2], _NONE) for k in range(len(word) - 1)]  # the rank of each part with the next
    while pairs and (low := min(pairs)) != _NONE:
        k = pairs.index(low)
        parts[k] += parts.pop(k + 1)
        del pairs[k]
        if k < len(pairs):
            pairs[k] = get(parts[k] + parts[k + 1], _NONE)
        if k:
            pairs[k - 1] = get(parts[k - 1] + parts[k], _NONE)
    return [ranks[x] for x in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As encode_word, in n log n: a heap of (rank, place, end) over a chain of parts; stale entries are passed over."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins here
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)

    def offer(at: int) -> None:
        if at >= 0 and end[at] < n and (r := ranks.get(word[at : end[end[at]]])) is not None:
            heapq.heappush(heap, (r, at, end[end[at]]))

    while heap:
        _, at, upto = heapq.heappop(heap)
        middle = end[at]
        if middle < 0 or middle >= n or end[middle] != upto:
            continue
        end[at], end[middle] = upto, -1
        if upto < n:
            before[upto] = at
        offer(at)
        offer(before[at])
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^31: their bit lengths, compressed, and then the bits below the first, by length."""
    numbers = numbers.astype(np.uint32) + np.uint32(1)
    length = np.empty(len(numbers), np.uint8)
    for k in range(0, len(numbers), _BITS_AT_ONCE):
        length[k : k + _BITS_AT_ONCE] = np.frexp(numbers[k : k + _BITS_AT_ONCE].astype(np.float64))[1] - 1
    out = [zstandard.ZstdCompressor(level=3).compress(length.tobytes())]
    for n in range(1, 32):
        own = numbers[length == n].astype("<u4")
        for k in range(0, len(own), _BITS_AT_ONCE):
            some = own[k : k + _BITS_AT_ONCE].view(np.uint8).reshape(-1, 4)
            out.append(np.packbits(np.unpackbits(some, axis=1, count=n, bitorder="little")).tobytes())
    return len(out[0]).to_bytes(8, "little") + b"".join(out)


def _unpack(data: bytes) -> np.ndarray:
    at = 8 + int.from_bytes(data[:8], "little")
    length = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:at]), np.uint8)
    numbers = np.ones(len(length), np.uint32)
    for n in range(1, 32):
        where = np.flatnonzero(length == n)
        for k in range(0, len(where), _BITS_AT_ONCE):
            m = len(where[k : k + _BITS_AT_ONCE])
            size = (m * n + 7) // 8
            bits = np.zeros((m, 32), np.uint8)
            bits[:, :n] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=m * n).reshape(m, n)
            bits[:, n] = 1
            numbers[where[k : k + _BITS_AT_ONCE]] = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
            at += size
    return numbers - np.uint32(1)


_MIXED = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("bucket", T.LongType()),  # -1: the block's documents and positions
        T.StructField("data", T.BinaryType()),
    ]
)
_MIXED_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
_DONE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(words)).tobytes() + lengths.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """Documents until the block is full: the distinct words, and each position as a word's number."""

    def __init__(self):
        self.words = _Numbers()
        self.doc_ids: list[str | None] = []
        self.counts: list[int] = []
        self.positions: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: str | None, text: str, split) -> None:
        own = np.array(list(map(self.words.__getitem__, split(text))), np.uint32)
        self.doc_ids.append(doc_id)
        self.counts.append(len(own))
        self.positions.append(own)
        self.chars += len(text)

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """A row with the documents and positions, and one with the words of each bucket."""
        words = [w.encode("utf-8", "surrogatepass") for w in self.words]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)  # equal prefixes meet and compress
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        positions = np.concatenate(self.positions)
        common = np.argsort(-np.bincount(positions, minlength=len(words)), kind="stable")  # small numbers for common words
        number = np.empty(len(words), np.uint32)
        number[common] = np.arange(len(words), dtype=np.uint32)
        head = pickle.dumps((self.doc_ids, self.counts, _pack(number[positions]), _pack(place[common])))
        sorted_buckets = bucket[order]
        borders = [0, *(np.flatnonzero(np.diff(sorted_buckets)) + 1).tolist(), len(words)]
        own = [(-1, head)]
        own += [(int(sorted_buckets[a]), _pack_words([words[i] for i in order[a:b].tolist()])) for a, b in zip(borders, borders[1:]) if b > a]
        for k in range(0, len(own), _ROWS):
            some = own[k : k + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array([b for b, _ in some], pa.int64()), pa.array([d for _, d in some], pa.binary())], schema=_MIXED_ARROW)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS, finish: tuple | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each whole text of docs (doc_id, text), without special tokens.

    finish, a schema and a function from a batch of doc_id and ids to a batch of that schema, runs
    in the worker that puts the ids in place, which saves a second one.

    A null text is empty and gives no ids. Repeated rows and null ids stay. Other columns are
    ignored. No documents give no rows. A text longer than a block is a block of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast((ranks, pattern))
    texts = docs.select(F.col("doc_id").cast("string"), "text")
    buckets = min(MOST_BUCKETS, 4 * max(1, texts.rdd.getNumPartitions()))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(vocabulary.value[1]).findall
        first, n, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.add(doc_id.as_py(), text.as_py() or "", split)
                if block.chars >= block_chars:
                    yield from block.rows(first + n, buckets)
                    block, n = _Block(), n + 1
        if block.doc_ids:
            yield from block.rows(first + n, buckets)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket's words are kept until it ends, and each is encoded once."""
        own = vocabulary.value[0]
        now, known = None, {}
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket == -1:
                    out.append(data)
                    continue
                if bucket != now or len(known) > MOST_KNOWN:
                    now, known = bucket, {}
                answers = []
                for word in _unpack_words(data):
                    if (ids := known.get(word)) is None:
                        known[word] = ids = np.array(encode_word(word, own), "<u4").tobytes()
                    answers.append(ids)
                out.append(_pack_words(answers))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], schema=_MIXED_ARROW)

    done_arrow = pa.schema([("doc_id", pa.string()), ("ids", pa.list_(pa.int32()))])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block and bucket: the positions, then the words' ids."""
        head, ids = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                if bucket == -1:
                    if head is not None:
                        yield from place(head, ids)
                    head, ids = data.as_py(), []
                else:
                    ids += _unpack_words(data.as_py())
        if head is not None:
            yield from place(head, ids)

    def place(head: bytes, ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc_ids, counts, positions, places = pickle.loads(head)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        places = _unpack(places)
        positions = _unpack(positions)
        ends = np.cumsum(np.array(counts, np.int64))
        at = 0
        while at < len(doc_ids):  # some documents at a time, so that no column of a batch gets too large
            before = int(ends[at - 1]) if at else 0
            upto = at + 1
            while upto < len(doc_ids) and ends[upto] - before < _PLACED_AT_ONCE:
                upto += 1
            own = places[positions[before : ends[upto - 1]]]
            n = lengths[own]
            total = np.concatenate(([0], np.cumsum(n)))
            picked = flat[np.arange(total[-1]) + np.repeat(starts[own] - total[:-1], n)]
            borders = total[np.concatenate(([0], ends[at:upto] - before))]
            lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(picked, pa.int32()))
            batch = pa.RecordBatch.from_arrays([pa.array(doc_ids[at:upto], pa.string()), lists], schema=done_arrow)
            yield finish[1](batch) if finish else batch
            at = upto

    exploded = texts.mapInArrow(tidy(explode), _MIXED)
    met = exploded.repartition(F.when(F.col("bucket") == -1, F.xxhash64("block")).otherwise(F.col("bucket")))
    answered = met.sortWithinPartitions("bucket").mapInArrow(tidy(look_up), _MIXED)
    by_block = answered.repartition("block").sortWithinPartitions("block", "bucket")
    done = by_block.mapInArrow(tidy(reassemble), finish[0] if finish else _DONE)
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def spelt(ids: list[int], by_id: dict[int, bytes]) -> bytes:
    """The bytes of the ids, each joined with its row of the token-byte table."""
    return b"".join(map(by_id.__getitem__, ids))


def decode(coded: DataFrame, ranks: dict[bytes, int], column: str = "ids", into: str = "decoded") -> DataFrame:
    """coded with the binary column `into`: the bytes of the ids, joined from the token-byte table.

    The table has a row for each token of the vocabulary, whatever the input, and is broadcast. A
    null list of ids gives null; an id that the table lacks is an error.
    """
    tokens = coded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    @F.pandas_udf(T.BinaryType())
    def spell(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else spelt(x.tolist(), tokens.value) for x in ids], dtype=object)

    return coded.withColumn(into, spell(F.col(column)))


@lru_cache(maxsize=1)
def ranks_of(path: str) -> dict[bytes, int]:
    return read_ranks(path)


def _digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool) -> DataFrame:
    tokens = docs.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    names = ["doc_id", "n_tokens", "ids" if with_ids else "ids_sha256", "decoded_sha256"]

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        borders, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        counts, own, decoded = [], [], []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            ids = flat[a:b]
            counts.append(b - a)
            own.append(None if with_ids else hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(spelt(ids.tolist(), tokens.value)).hexdigest())
        second = lists if with_ids else pa.array(own, pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), second, pa.array(decoded, pa.string())], names=names)

    kinds = [T.StringType(), T.LongType(), T.ArrayType(T.IntegerType()) if with_ids else T.StringType(), T.StringType()]
    return encode(docs, ranks, pattern, finish=(T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]), finish))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256.

    Null, empty and long texts, repeated rows, null ids and empty tables as in encode.
    """
    return _digests(docs, ranks, pattern, False)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The last step of a corpus: doc_id, n_tokens, ids and the sha256 of the decoded text.

    Null, empty and long texts, repeated rows, null ids and empty tables as in encode; columns of docs but
    doc_id and text are left out.
    """
    return _digests(docs, ranks, pattern, True)
