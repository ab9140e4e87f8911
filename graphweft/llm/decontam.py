"""Benchmark decontamination by a generalised suffix automaton over words (free style)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import materialise, once_per_worker, small_batches, tidy

# Fixed by the contract: A-Z become a-z, every other ASCII character that is no digit separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """All word sequences of a block of items; states know which items they occur in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            if ids:
                coded.append((item, ids))
                last = 0
                for x in ids:
                    last = self._extend(last, x)
        self._attribute(coded)
        self.shortest = min([window, *(len(ids) for _, ids in coded)]) if coded else 0

    def _clone(self, p: int, q: int, x: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _extend(self, last: int, x: int) -> int:
        q = self.next[last].get(x)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, x)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, x)
        return new

    def _attribute(self, coded: list[tuple[str, list[int]]]) -> None:
        """For each state: the state of its window-long suffix, and the short items that end with it."""
        n, w = len(self.next), self.window
        self.items: list[set[str] | None] = [None] * n
        short: list[dict[int, set[str]] | None] = [None] * n
        for item, ids in coded:
            s = 0
            for x in ids:
                s = self.next[s][x]
                if self.len[s] >= w and len(ids) >= w:
                    t = s
                    while self.len[self.link[t]] >= w:
                        t = self.link[t]
                    if self.items[t] is None:
                        self.items[t] = set()
                    self.items[t].add(item)
            if len(ids) < w:
                if short[s] is None:
                    short[s] = {}
                short[s].setdefault(len(ids), set()).add(item)
        self.at: list[int] = [-1] * n
        self.short: list[tuple] = [()] * n
        for s in sorted(range(1, n), key=self.len.__getitem__):
            up = self.link[s]
            if self.len[s] >= w:
                self.at[s] = self.at[up] if self.len[up] >= w else s
            own = tuple((k, frozenset(v)) for k, v in (short[s] or {}).items())
            self.short[s] = self.short[up] + own

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans [first, last] of hit words, and the items with an occurring window."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        gaps = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
        spans: list[list[int]] = []
        found: set[str] = set()
        for k in np.flatnonzero(np.diff(gaps) > self.shortest).tolist():
            self._run(ids, int(gaps[k]) + 1, int(gaps[k + 1]), spans, found)
        return spans, found

    def _run(self, ids: np.ndarray, begin: int, end: int, spans: list[list[int]], found: set[str]) -> None:
        s = matched = 0
        w = self.window
        for i, x in enumerate(ids[begin:end].tolist(), begin):
            while s and x not in self.next[s]:
                s = self.link[s]
                matched = self.len[s]
            t = self.next[s].get(x)
            if t is None:
                continue
            s, matched = t, matched + 1
            reach = 0
            if matched >= w and (items := self.items[self.at[s]]):
                reach = w
                found |= items
            for k, items in self.short[s]:
                if k <= matched:
                    reach = max(reach, k)
                    found |= items
            if reach:
                first = i - reach + 1
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and spans[-1][1] >= first - 1:
                    spans[-1][1] = i
                else:
                    spans.append([first, i])


_SPANS = "array<struct<first:int,last:int>>"


def _blocks(benchmark: DataFrame, most_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark in blocks of a bounded number of words; a longer item is a block of its own."""
    block, n = [], 0
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").distinct()
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if block and n + len(words) > most_words:
            yield block
            block, n = [], 0
        block.append((item, words))
        n += len(words)
    yield block


_FRAME = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _as_spans(spans: list) -> list[dict]:
    return [{"first": a, "last": b} for a, b in spans]


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 200_000, finish: tuple | None = None) -> DataFrame:
    """docs' (doc_id, text) with n_words, hit spans of word positions, and the item ids that occur.

    Each block of at most `block_words` benchmark words is broadcast and becomes one automaton in each Python
    worker; all documents stream past it. Words that no item has cut a text into runs; shorter runs than
    the shortest window can't match and are skipped. With several blocks each is a pass of its own that
    writes only what it hits, by the hash of the text, once for equal texts; the passes are then joined back.
    `finish` (schema, function of a batch) is applied to the batches in the worker that made them.
    """
    small_batches(spark)
    blocks = _blocks(benchmark, block_words)
    block, following = next(blocks), next(blocks, None)
    schema = docs.select(
        "doc_id", "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items")
    ).schema

    def told(batch: pa.RecordBatch, n_words: list, spans: list, items: list) -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip((n_words, spans, items), _FRAME))], names=["doc_id", "text", *_FRAME.names])
        return finish[1](done) if finish else done

    if following is None:
        find = _finder(spark, block, window)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [find(text.as_py()) for text in batch.column(1)]
                yield told(batch, [n for n, _, _ in found], [_as_spans(s) for _, s, _ in found], [sorted(i) for _, _, i in found])

        return docs.select("doc_id", "text").mapInArrow(tidy(scan), finish[0] if finish else schema)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hi"), F.xxhash64(F.lit(1), "text").alias("lo"))
    parts = []
    while block is not None:
        parts.append(_hits(spark, keyed, _finder(spark, block, window)))
        block, following = following, next(blocks, None)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("hi", "lo").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # a row a block
    joined = keyed.join(materialise(spark, merged, "decontam-hits"), ["hi", "lo"], "left").select("doc_id", "text", "spans", "items")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = [len(words_of(text.as_py())) for text in batch.column(1)]
            spans = [_as_spans(_merge([(x["first"], x["last"]) for x in own or []])) for own in batch.column(2).to_pylist()]
            yield told(batch, n_words, spans, [sorted(set(own or [])) for own in batch.column(3).to_pylist()])

    return joined.mapInArrow(tidy(gather), finish[0] if finish else schema)


def _finder(spark: SparkSession, block: list, window: int):
    """A function from a text to its number of words, hit spans and items, for one block of the benchmark."""
    sent = spark.sparkContext.broadcast(block)
    key = ("decontam", sent._jbroadcast.id(), window)

    def find(text: str | None) -> tuple[int, list, set[str]]:
        words = words_of(text)
        return len(words), *once_per_worker(key, lambda: SuffixAutomaton(sent.value, window)).scan(words)

    return find


def _hits(spark: SparkSession, keyed: DataFrame, find) -> DataFrame:
    """(hi, lo, spans, items): what one block hits, one row for each text that it hits, written to the shared folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(text.as_py()) for text in batch.column(2)]
            at = [k for k, (_, spans, _) in enumerate(found) if spans]
            columns = [c.take(pa.array(at, pa.int64())) for c in (batch.column(0), batch.column(1))]
            lists = [pa.array([_as_spans(found[k][1]) for k in at], _FRAME.field(1).type), pa.array([sorted(found[k][2]) for k in at], _FRAME.field(2).type)]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=["hi", "lo", "spans", "items"])

    own = keyed.select("hi", "lo", "text").mapInArrow(tidy(scan), f"hi bigint, lo bigint, spans {_SPANS}, items array<string>")
    return materialise(spark, own.dropDuplicates(["hi", "lo"]), "decontam-block")


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; items with a null id or text are ignored;
    repeated documents are reported each, repeated items once. No documents give no rows, no
    benchmark gives no hits. Other columns are ignored.
    """
    found = matches(spark, docs, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : places[first][0]])
        at = places[last][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, most_coverage: float = 0.5) -> DataFrame:
    """docs (doc_id, text and any other columns) without benchmark passages.

    Every hit span is cut from its text; a document of which more than `most_coverage` of the words
    is hit goes. n_chars, if there is one, is counted anew for the texts that change. Clean rows, null and
    empty texts included, are returned as they are; repeated rows are each treated alike. Other columns keep
    their values whatever their names. No benchmark changes nothing; no documents give no rows.
    """
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "text")]
    carried = docs.select("text", F.struct("doc_id", *(f"`{c}`" for c in rest)).alias("doc_id"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, texts, changed = [], [], []
        for k, (text, n_words, spans) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            own = [(s["first"], s["last"]) for s in spans]
            if sum(b - a + 1 for a, b in own) <= n_words * most_coverage:
                kept.append(k)
                texts.append(cut_spans(text.as_py(), own) if own else text.as_py())
                changed.append(bool(own))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(texts, pa.string()), pa.array(changed, pa.bool_())], names=["doc_id", "text", "cut"])

    kind = T.StructType([carried.schema["doc_id"], carried.schema["text"], T.StructField("cut", T.BooleanType())])
    done = matches(spark, carried, benchmark, window, finish=(kind, cut))
    out = {c: F.col(f"doc_id.`{c}`") for c in ["doc_id", *rest]} | {"text": F.col("text")}
    if "n_chars" in rest:
        out["n_chars"] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return done.select(*[out[c].alias(c) for c in columns])
