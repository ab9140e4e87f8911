"""Quality by random Fourier features over document statistics (free style).

Statistics of each text are standardised and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel. Partitions sum the normal equations of a ridge regression; isotonic
regression on rows that the ridge has not seen turns its output into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import bounded_labels, distinct_text_sample, held_out

FOLDS, HELD_OUT = 4, 2
MOST_LABELLED = 40_000  # labelled rows to learn from, at most
FEATURES = 256
RIDGE = 1.0
SEED = 7
GOOD = 0.7
_CLASSES = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line break, 6 sentence mark, 7 other mark, 8 beyond ASCII
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".,;:'", b"!?\"#$%&()*+-/<=>@[\\]^_`{|}~", range(128, 256)), 1):
    _CLASSES[list(_chars)] = _k
_MARKS = list(b"!?#$%&*|{}<>=/\\")


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; an empty one has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(29)
    each = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASSES, weights=each, minlength=9) / len(raw)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    count = Counter(words)
    lines = raw.split(b"\n")
    share = np.fromiter(count.values(), float, len(count)) / n
    top = max(count.values())
    lower = raw.lower()
    ends = np.fromiter((w[-1] for w in words), np.uint8, n)
    pairs = len(set(zip(words, words[1:])))
    chars = each[each > 0] / len(raw)
    shouting = sum(map(bytes.isupper, words))
    return np.array(
        [
            np.log1p(n), np.log1p(len(lines)), lengths.mean(), np.log1p(lengths.max()), lengths.std(), *kinds[1:9],
            len(count) / n, top / n, pairs / max(1, n - 1), float(-(share * np.log(share)).sum()), len(set(lines)) / len(lines), n / len(lines) / (10 + n / len(lines)),
            float((_CLASSES[ends] == 7).mean()), float((_CLASSES[ends] == 6).mean()), float((lengths == 1).mean()), shouting / n, each[ord("|")] / n, each[_MARKS].sum() / n,
            float(-(chars * np.log(chars)).sum()), lower.count(b"http") / n, sum(map(bytes.isdigit, words)) / n, float(raw.count(b"\n\n")) / len(lines),
        ]
    )


def with_statistics(frame: DataFrame, column: str = "text") -> DataFrame:
    """frame with stats array<double> of the text instead of the text."""
    kept = [c for c in frame.columns if c != column]
    at, others = frame.columns.index(column), [frame.columns.index(c) for c in kept]
    schema = frame.select(*kept).withColumn("stats", F.array().cast("array<double>")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()).tolist() for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in others), pa.array(stats, pa.list_(pa.float64()))], names=[*kept, "stats"])

    return frame.mapInArrow(scan, schema)


def fourier(stats: np.ndarray, model: dict) -> np.ndarray:
    x = np.clip((stats - model["mean"]) / model["scale"], -6, 6)
    z = np.cos(x @ model["waves"] + model["phases"]) * np.sqrt(2 / FEATURES)
    return np.column_stack([np.ones(len(z)), z])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit: pooled neighbours, each at its mean x, levels rising.

    Equal x are pooled first, so that the order of the rows doesn't matter. The levels are drawn towards one
    half by the weight of a single row, which keeps their order.
    """
    at, where = np.unique(x, return_inverse=True)
    n = np.bincount(where, minlength=len(at)).astype(float)
    sums = np.bincount(where, weights=y, minlength=len(at))
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for value, weight, total in zip(at.tolist(), n.tolist(), sums.tolist()):
        blocks.append([total, weight, value * weight])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    levels = np.array([total / weight for total, weight, _ in blocks])
    return np.array([value / weight for _, weight, value in blocks]), (levels * len(x) + 0.5) / (len(x) + 1)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict:
    """The model. At most MOST_LABELLED labelled rows outside the held-out fold are learnt from, one
    for each distinct text. One in five of them fits the calibration, the rest the ridge; if that leaves
    none to calibrate with, all do. Without labels every score is one half; labels of one kind only give
    all texts about that kind's score. Null and empty texts are learnt from like any other."""
    sample = distinct_text_sample(docs, bounded_labels(labels, "quality", FOLDS, HELD_OUT, MOST_LABELLED))
    sample = sample.select("doc_id", (F.col("label") > 0).cast("int").alias("label")).collect()
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = spark.createDataFrame([(r["doc_id"], r["label"]) for r in sample], f"doc_id {kind}, label int")
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", calibrating.alias("calibrating"), "text"))
    rows = rows.cache()
    width = len(statistics(""))
    sums = [f for k in range(width) for f in (F.avg(F.col("stats")[k]).alias(f"m{k}"), F.stddev_pop(F.col("stats")[k]).alias(f"s{k}"))]
    row = rows.agg(F.count("*").alias("n"), *sums).first()
    if not row["n"]:
        return {}
    random = np.random.default_rng(SEED)
    model = {
        "mean": np.array([row[f"m{k}"] for k in range(width)]),
        "scale": np.array([max(row[f"s{k}"], 1e-6) for k in range(width)]),
        "waves": random.normal(size=(width, FEATURES)) / np.sqrt(width),
        "phases": random.uniform(0, 2 * np.pi, FEATURES),
    }

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                z = fourier(np.array(batch.column(1).to_pylist()), model)
                a += z.T @ z
                b += z.T @ np.array(batch.column(0).to_pylist(), float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    parts = rows.filter("not calibrating").select("label", "stats").coalesce(8).mapInArrow(normal, "a binary, b binary").collect()
    a = sum(np.frombuffer(p["a"]).reshape(FEATURES + 1, -1) for p in parts)
    b = sum(np.frombuffer(p["b"]) for p in parts)
    model["weights"] = np.linalg.solve(a + RIDGE * np.eye(len(b)), b)
    held = rows.filter("calibrating").select("label", "stats").collect() or rows.select("label", "stats").collect()  # MOST_LABELLED rows at most
    rows.unpersist()
    raw = fourier(np.array([r["stats"] for r in held]), model) @ model["weights"]
    model["knots"], model["levels"] = isotonic(raw, np.array([r["label"] for r in held], float))
    return model


def score(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row of docs: the calibrated probability of good quality.

    A null or empty text is scored by its zero statistics. Repeated rows and null ids stay.
    """
    sent = spark.sparkContext.broadcast(model)
    stats = with_statistics(docs.select("doc_id", "text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if not model or not batch.num_rows:
                scores = np.full(batch.num_rows, 0.5)
            else:
                raw = fourier(np.array(batch.column(1).to_pylist()), model) @ model["weights"]
                # within a level the ridge's order stays
                scores = np.clip(np.interp(raw, model["knots"], model["levels"]) + 1e-4 * (np.clip(raw, 0, 1) - 0.5), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return stats.mapInArrow(rate, docs.select("doc_id").withColumn("score", F.lit(0.0)).schema)


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null doc_id counts as held out. A null text is empty, and an empty one is scored by its zero
    statistics; whole texts of any length count. Repeated rows are scored each, and alike. No documents
    give no rows. Other columns are ignored.
    """
    scored = score(spark, docs, fit(spark, docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
