"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of a document are standardised and mapped to ``cos(x W + b)`` with normal W, which
approximates a Gaussian kernel.  Tasks sum the normal equations of their rows, the sums are added
per matrix row on the cluster, and one small system is solved.  Another part of the labelled rows
gives an isotonic (monotone) map from raw scores to the share of label 1, fitted on a histogram of
bounded size.  Every document is then scored from its written statistics.

Labels are learnt from rows whose crc32(doc_id) mod 5 is not 0: remainder 4 calibrates, the others
fit.  At most about ``max_rows`` labelled rows are used, chosen by a hash of the id.  Null and empty
texts have statistics too (zeros) and so a score; a null id counts as held out.  A label that is null
or neither 0 nor 1 is ignored, and of several labels of an id the smallest counts.  Without labels
every score is 0.5; with one class, the calibration map is that class.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.session import materialize

NAMES = (
    "words", "chars", "word_length", "word_spread", "distinct", "top_share", "repeats", "pairs_distinct", "symbols", "digits", "upper", "capital_words",
    "stops", "commas", "bars", "marks", "lines", "line_distinct", "non_ascii", "short_words", "symbol_ends", "longest_run", "half_gap",
)
SYMBOLS = np.array([ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"])
ENDS = b"#$%&*+/<=>@\\^_|~!"
BINS, LOW, HIGH = 1000, -0.5, 1.5
#: Scores below it are rejected.
THRESHOLD = 0.3


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text, in the order of NAMES."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    most = Counter(words).most_common(1)[0][1]
    distinct = len(set(words))
    same = np.fromiter(map(eq, words, words[1:]), bool, n - 1)
    edges = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    ends = np.fromiter((w[-1] in ENDS for w in words), bool, n)
    half = n // 2
    gap = abs(float(ends[:half].mean()) - float(ends[half:].mean())) if half else 0.0
    return [
        np.log1p(n), np.log1p(size), float(lengths.mean()), float(lengths.std()), distinct / n, most / n, float(same.mean()) if n > 1 else 0.0,
        len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 1.0, float(count[SYMBOLS].sum()) / size, float(count[48:58].sum()) / size,
        upper / max(upper + lower, 1), sum(w.isupper() for w in words) / n, float(count[ord(".")]) / n, float(count[ord(",")]) / n, float(count[ord("|")]) / n,
        float(count[ord("!")] + count[ord("?")]) / n, len(lines) / n, len(set(lines)) / len(lines), float(count[128:].sum()) / size, float((lengths <= 3).mean()),
        float(ends.mean()), np.log1p(int(np.diff(edges).max())), gap,
    ]


def document_statistics(docs: DataFrame, ids: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """(doc_id, part, stats[, keep]) per document; nothing but the text enters ``stats``, ``keep`` is carried along."""
    more = [keep] * bool(keep)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t.as_py() or b"") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stats, pa.list_(pa.float64())), *b.columns[3:]], names=["doc_id", "part", "stats", *more])

    part = F.pmod(F.crc32(F.coalesce(F.col(ids).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")
    return docs.select(F.col(ids).cast("bigint").alias("doc_id"), part.alias("part"), F.col(text).cast("string").cast("binary").alias("text"), *more).mapInArrow(run, "doc_id bigint, part int, stats array<double>" + "".join(f", `{c}` {kinds[c]}" for c in more))


class Model:
    """The fitted map from statistics to a score."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.std = mean, std
        self.w = rng.standard_normal((d, features)) / np.sqrt(d)  # a kernel as wide as a typical distance
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta: np.ndarray | None = None
        self.knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def map(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.hstack([np.ones((len(x), 1)), z])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(NAMES))


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over (label, stats): per task, then per matrix row on the cluster."""
    size = model.w.shape[1] + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            z = model.map(_matrix(b.column(1)))
            total += z.T @ np.hstack([z, np.asarray(b.column(0), float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [group["i"].iloc[0]], "row": [np.sum(np.stack(group["row"].to_list()), axis=0)]})

    sums = rows.select("label", "stats").mapInArrow(partial, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").collect()
    full = np.zeros((size, size + 1))
    for r in sums:
        full[r["i"]] = r["row"]
    return full[:, :-1], full[:, -1]


def isotonic(centre: np.ndarray, ones: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over histogram bins; knots of the monotone map."""
    blocks: list[list[float]] = []  # ones, total, sum of centres
    for c, o, t in zip(centre, ones, total, strict=True):
        blocks.append([o, t, c * t])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o, t, s = blocks.pop()
            blocks[-1] = [blocks[-1][0] + o, blocks[-1][1] + t, blocks[-1][2] + s]
    return np.array([s / t for _, t, s in blocks]), np.array([o / t for o, t, _ in blocks])


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, ridge: float = 1e-3, max_rows: int = 200_000, seed: int = 7, tasks: int = 16) -> Model:
    """Fit on written statistics; ``labels`` has doc_id and quality."""
    lab = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    rows = stats.filter("part <> 0").join(lab, "doc_id").select("part", "label", "stats", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("pick"))
    rows = materialize(rows, "labelled")
    n = rows.count()
    rows = rows.filter(F.col("pick") < F.lit(int((1 << 30) * min(1.0, max_rows / max(n, 1))))).coalesce(tasks)
    cols = [F.col("stats")[i] for i in range(len(NAMES))]
    m = rows.filter("part <> 4").agg(F.count("*"), *(F.avg(c) for c in cols), *(F.stddev_pop(c) for c in cols)).first()
    if not m[0]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), features, seed)
    d = len(NAMES)
    model = Model(np.array(m[1 : d + 1], float), np.maximum(np.array(m[d + 1 :], float), 1e-6), features, seed)
    a, y = normal_equations(rows.filter("part <> 4"), model)
    model.beta = np.linalg.solve(a + ridge * max(m[0], 1) / features * np.eye(len(a)), y)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.clip((model.raw(_matrix(b.column(1))) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0)], names=["bin", "label"])

    seen = [r for r in _histogram(rows.filter("part = 4"), bins)] or [r for r in _histogram(rows.filter("part <> 4"), bins)]
    at, ones, total = (np.array(x, float) for x in zip(*sorted(seen), strict=True))
    model.knots = isotonic(LOW + (at + 0.5) * (HIGH - LOW) / BINS, ones, total)
    return model


def _histogram(rows: DataFrame, bins) -> list[tuple[int, float, int]]:  # noqa: ANN001
    return [tuple(r) for r in rows.select("label", "stats").mapInArrow(bins, "bin int, label double").groupBy("bin").agg(F.sum("label"), F.count("*")).collect()]  # at most BINS rows


def score(stats: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """(doc_id, part, score[, keep]) of written statistics."""
    more = [keep] * bool(keep)
    kinds = {f.name: f.dataType.simpleString() for f in stats.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(_matrix(b.column(2)))), *b.columns[3:]], names=["doc_id", "part", "score", *more])

    return stats.select("doc_id", "part", "stats", *more).mapInArrow(run, "doc_id bigint, part int, score double" + "".join(f", `{c}` {kinds[c]}" for c in more))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:  # noqa: ANN003
    """(doc_id, held_out, score, predicted) per document."""
    stats = materialize(document_statistics(docs), "statistics")
    out = score(stats, fit(stats, labels, **options))
    return out.select("doc_id", (F.col("part") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
