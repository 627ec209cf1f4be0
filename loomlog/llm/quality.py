"""Operator 7: quality by a generalised additive model with pairwise interactions.

Features are counts and shares of a whole text. Each is binned at quantiles; cyclic
boosting goes round the features, fitting each time a shallow tree on that one
feature's bins to the residuals and adding its steps to the feature's table. The
pairs that lower the residual most then get tables of two dimensions in the same
way. A score is the logistic of the sum of the looked-up table entries, so scoring
is a search for bins and additions of arrays.

Only labelled rows whose crc32(doc_id as text) mod 5 isn't 0 are learnt from, and
at most ``SAMPLE`` of them, those with the smallest hash of doc_id: the one bound
here, and a documented parameter. Every document is scored, over its whole text.
doc_id, lang, source and labels are no inputs of a score.

Null texts count as empty, and an empty text has a score like any other. A row with
a null doc_id has no label and isn't held out. Labels that are null or neither 0
nor 1 are left out; of repeated labels of a document the largest counts, and of the
texts of a repeated doc_id the one whose features are least. Without
labels of both kinds every score is the share of 1 among them, or 0.5. An empty table
gives an empty result. Further columns, of any name, pass through ``scored``.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import caches, common

SAMPLE = 20_000
THRESHOLD = 0.3
SCORE = "__quality_score"

FEATURES = (
    "log_chars", "log_words", "word_chars", "long_words", "distinct_words", "sampled_word", "repeats_next",
    "upper", "digits", "spaces", "newlines", "stops", "commas", "exclaims", "symbols", "pipes", "quotes",
    "brackets", "non_ascii", "line_chars", "distinct_lines", "lines_ended", "capital_words", "compressed",
)

_SYMBOLS = np.frombuffer(b"#$%&*@^~=+<>\\/_", np.uint8)


def features(text: str) -> list[float]:
    """One number for each of FEATURES."""
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n, w, k = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    distinct = set(words)
    letters = max(int(seen[65:91].sum() + seen[97:123].sum()), 1)
    # the commonest of the first, middle and last words: where one word fills a text it's among them
    top = max((words.count(x) for x in {words[0], words[len(words) // 2], words[-1]}), default=0) if words else 0
    joined = len(raw) - int(seen[32] + seen[10] + seen[9] + seen[13])
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        joined / w,
        max(map(len, distinct), default=0),
        len(distinct) / w,
        top / w,
        sum(map(operator.eq, words, words[1:])) / w,
        seen[65:91].sum() / letters,
        seen[48:58].sum() / n,
        seen[32] / n,
        seen[10] / w,
        seen[46] / w,
        seen[44] / w,
        seen[33] / w,
        seen[_SYMBOLS].sum() / w,
        seen[124] / w,
        (seen[34] + seen[39]) / w,
        seen[[40, 41, 91, 93, 123, 125]].sum() / w,
        seen[128:].sum() / n,
        np.log1p(n / k),
        len(set(lines)) / k,
        sum(x.endswith((".", "!", "?")) for x in lines) / k,
        sum(map(str.istitle, words)) / w,
        len(zlib.compress(raw, 1)) / n,
    ]


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, damp: float) -> np.ndarray:
    """Steps of a tree with up to so many leaves on one feature's bins."""
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + damp)
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = gs[:-1] ** 2 / (hs[:-1] + damp) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + damp) - gs[-1] ** 2 / (hs[-1] + damp)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = value(a, b)
    return out


def _square(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[float, np.ndarray]:
    """The gain and the steps of the best tree that cuts a pair's grid once in each dimension."""
    gs, hs = np.zeros(np.add(g.shape, 1)), np.zeros(np.add(g.shape, 1))
    gs[1:, 1:], hs[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)

    def parts(s):
        a = s[1:-1, 1:-1]
        right, low, whole = s[1:-1, -1:] - a, s[-1:, 1:-1] - a, s[-1, -1]
        return a, right, low, whole - a - right - low

    gp, hp = parts(gs), parts(hs)
    gain = sum(x**2 / (y + damp) for x, y in zip(gp, hp, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [x[i, j] / (y[i, j] + damp) for x, y in zip(gp, hp, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1, leaves: int = 3, damp: float = 5.0) -> Model:
    """Main effects by cyclic boosting, then the strongest pairs on what they leave."""
    if len(y) == 0:
        return Model()
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Model(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(d)]
    model.coarse = [_edges(x[:, j], coarse) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            r, v = slopes()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(cells[j], r, size), np.bincount(cells[j], v, size), leaves, damp)
            model.tables[j] += step
            total += step[cells[j]]
    grid = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def histogram(i, j, weights):
        return np.bincount(grid[i] * sizes[j] + grid[j], weights, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    r, v = slopes()
    gains = sorted(((_square(histogram(i, j, r), histogram(i, j, v), damp)[0], i, j) for i in range(d) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            r, v = slopes()
            step = rate * _square(histogram(i, j, r), histogram(i, j, v), damp)[1]
            table += step
            total += step[grid[i], grid[j]]
    return model


def _vectors(batches):
    caches.only()
    for b in batches:
        rows = [features(x or "") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def held_out():
    """The rows that no model learns from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows that aren't held out."""
    common.prepare(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    rows = texts.mapInArrow(_vectors, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(known), "doc_id").select("doc_id", "x", "y").toArrow()
    rows = rows.sort_by("doc_id")
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy().astype(float))


def _score(batches, model):
    caches.only()
    for b in batches:
        rows = np.array([features(x or "") for x in b.column(b.schema.get_field_index("__quality_text")).to_pylist()], float).reshape(-1, len(FEATURES))
        at = b.schema.get_field_index("__quality_text")
        rest = [k for k in range(b.num_columns) if k != at]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), pa.array(model.value.score(rows), pa.float64())], names=[*(b.schema.names[k] for k in rest), SCORE])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column SCORE; no shuffle."""
    spark = docs.sparkSession
    common.prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = common.extended(docs.schema, **{SCORE: T.DoubleType()})
    return docs.withColumn("__quality_text", common.text_of()).mapInArrow(lambda x: _score(x, sent), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of THRESHOLD or more, all columns as they were."""
    model = train(docs, labels)
    return common.renamed(docs, lambda df: scored(df, model).where(F.col(SCORE) >= THRESHOLD).drop(SCORE))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's score."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))
