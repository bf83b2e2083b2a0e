"""Quality classifier by co-training: a text view and a metadata view teach each other, calibrated scores are combined."""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import packed, unpacked

#: Hashed words and hashed word shapes of the text view, hashed values of the metadata view.
WORDS, SHAPES, VALUES = 1 << 14, 1 << 8, 1 << 9
#: Words that a task remembers before it starts afresh; nothing but time depends on it.
REMEMBERED = 300_000
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
BLANK = b" \t\n\x0b\f\r"


class _Hashed(dict):
    """Word -> hashed word and hashed shape in one number; a shape keeps one sign a run of like characters."""

    def __missing__(self, word: str) -> int:
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a",
                                                re.sub(r"\d", "0", word)))
        value = zlib.crc32(word.encode()) % WORDS * SHAPES + zlib.crc32(shape.encode()) % SHAPES
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


_HASHED = _Hashed()


def text_view(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Indexes and values of hashed words and shapes (roots of their shares), and how repetitive the words are."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32), [0.0] * 3
    both = np.fromiter(map(_HASHED.__getitem__, words), np.int64, n)
    count = np.bincount(both // SHAPES, minlength=WORDS)
    shape = np.bincount(both % SHAPES, minlength=SHAPES)
    at, of = np.flatnonzero(count), np.flatnonzero(shape)
    values = np.sqrt(np.r_[count[at], shape[of]] / n)
    return (np.r_[at, WORDS + of].astype(np.int32), values.astype(np.float32),
            [len(at) / n ** 0.75, float(count.max()) / n, np.log1p(n)])


def metadata_view(text: str, values: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed metadata values, and the layout: length, lines, shares of kinds of characters; no word is looked at."""
    at = np.unique([zlib.crc32(f"{i}={v}".encode()) % VALUES for i, v in enumerate(values)]).astype(np.int32)
    raw = text.encode()
    size = max(1, len(raw))
    shares = [(len(raw) - len(raw.translate(None, kind))) / size for kind in (UPPER, DIGITS, SIGNS, BLANK)]
    lines = raw.count(b"\n") + 1
    return at, np.ones(len(at), np.float32), [np.log1p(len(raw)), np.log1p(lines), np.log1p(size / lines), *shares]


@dataclass
class View:
    """Rows of one view as index, value and row arrays with dense columns."""

    at: np.ndarray
    value: np.ndarray
    row: np.ndarray
    dense: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray, list[float]]], size: int) -> View:
        lengths = [len(r[0]) for r in rows]
        return cls(np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int32),
                   np.concatenate([r[1] for r in rows]) if rows else np.empty(0, np.float32),
                   np.repeat(np.arange(len(rows)), lengths), np.array([r[2] for r in rows], float), size)


@dataclass
class Linear:
    """Logistic regression on a view; ``a`` and ``b`` calibrate its margin."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def margin(self, x: View) -> np.ndarray:
        sparse = np.bincount(x.row, x.value * self.weights[x.at], minlength=len(x.dense))
        return sparse + ((x.dense - self.mean) / self.scale) @ self.dense + self.bias

    def chance(self, x: View) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))


def fit(x: View, rows: np.ndarray, y: np.ndarray, start: Linear | None = None, steps: int = 80) -> Linear:
    """Logistic regression on some rows of a view, both classes weighing the same, by Adam steps over all of them."""
    mean = start.mean if start else x.dense[rows].mean(0)
    scale = start.scale if start else x.dense[rows].std(0) + 1e-6
    place = np.full(len(x.dense), -1)
    place[rows] = np.arange(len(rows))
    own = place[x.row] >= 0
    at, value, row = x.at[own], x.value[own], place[x.row[own]]
    dense = (x.dense[rows] - mean) / scale
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    sizes = (x.size, dense.shape[1], 1)
    theta = np.concatenate([start.weights, start.dense, [start.bias]]) if start else np.zeros(sum(sizes))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    cut = [sizes[0], sizes[0] + sizes[1]]
    for t in range(1, steps + 1):
        w, d, b = np.split(theta, cut)
        margin = np.bincount(row, value * w[at], minlength=len(rows)) + dense @ d + b[0]
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        grad = np.concatenate([np.bincount(at, value * error[row], minlength=x.size), dense.T @ error, [error.sum()]])
        grad += 1e-4 * np.r_[w, d, 0.0]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        theta = theta - 0.1 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    w, d, b = np.split(theta, cut)
    return Linear(w, d, float(b[0]), mean, scale)


def calibrate(model: Linear, x: View, rows: np.ndarray, y: np.ndarray) -> None:
    """Fit ``a`` and ``b`` on rows that no model was fitted on (Newton steps on the smoothed labels)."""
    m = model.margin(x)[rows]
    up, down = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - goal) * m).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    model.a, model.b = float(max(a, 1e-3)), float(b)


@dataclass
class Models:
    """The two views' models and the weights of their calibrated log-odds."""

    text: Linear
    metadata: Linear
    blend: np.ndarray

    def chances(self, text: View, metadata: View) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text.chance(text), self.metadata.chance(metadata)
        return t, m, 1 / (1 + np.exp(-odds(t, m) @ self.blend))


def odds(t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Columns for the blend: log-odds of both views, within 8 of zero, and a constant."""
    return np.column_stack([np.clip(np.log(p) - np.log1p(-p), -8, 8) for p in (t, m)] + [np.ones(len(t))])


def blend(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of both log-odds, fitted on held rows and drawn towards the plain mean; both views count, if little."""
    prior = np.array([0.5, 0.5, 0.0])
    theta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x.T * (p * (1 - p))) @ x + np.eye(3)
        theta = np.maximum(theta - np.clip(np.linalg.solve(hess, x.T @ (p - y) + (theta - prior)), -0.5, 0.5), [0.05, 0.05, -5])
    return theta


def co_train(views: tuple[View, View], y: np.ndarray, held: np.ndarray, rounds: int, exchange: int, sure: float) -> Models:
    """Models from rows with label ``y`` (-1: none); ``held`` rows serve for calibration only.

    In each round both models are fitted on their own rows; each then gives the other the pool rows that it is most sure of,
    at most ``exchange``, in the classes' proportion, and only beyond a chance of ``sure``.
    """
    base = np.flatnonzero((y >= 0) & ~held)
    label = [y.copy(), y.copy()]
    rows = [base, base]
    models: list[Linear | None] = [None, None]
    share = (y[base] == 1).mean()
    for r in range(rounds + 1):
        models = [fit(views[v], rows[v], label[v][rows[v]], models[v], 80 if r == 0 else 30) for v in (0, 1)]
        if r == rounds:
            break
        given = []
        for v in (0, 1):
            chance = models[v].chance(views[v])
            pool = np.setdiff1d(np.flatnonzero(y < 0), rows[1 - v])
            for cls, part in ((1, share), (0, 1 - share)):
                score = chance[pool] if cls else 1 - chance[pool]
                best = np.argsort(-score, kind="stable")[:int(round(exchange * part))]
                given.append((1 - v, pool[best[score[best] >= sure]], cls))
        for v, new, cls in given:
            new = np.setdiff1d(new, rows[v])
            label[v][new] = cls
            rows[v] = np.r_[rows[v], new]
    for v in (0, 1):
        calibrate(models[v], views[v], np.flatnonzero(held), y[held])
    both = odds(*(models[v].chance(views[v])[held] for v in (0, 1)))
    return Models(models[0], models[1], blend(both, y[held]))


def _views(batch: pa.RecordBatch, n_values: int) -> list[tuple]:
    """Both views of each row of a batch with ``_text`` and ``_v0``, ``_v1``, ..."""
    columns = [batch.column(f"_v{i}").to_pylist() for i in range(n_values)]
    out = []
    for i, text in enumerate(batch.column("_text")):
        text = text.as_py() or ""
        out.append((text_view(text), metadata_view(text, [c[i] for c in columns])))
    return out


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          meta_cols: tuple[str, ...] = ("source", "lang"), label_col: str = "quality", fit_rows: int = 6000,
          pool_rows: int = 6000, rounds: int = 3, exchange: int = 300, sure: float = 0.97) -> Models | None:
    """The models, or None if the labelled documents are not of both classes.

    The fit uses at most ``fit_rows`` labelled rows and a pool of at most ``pool_rows`` others, both taken by the hash of the
    id, so that they do not depend on the tables' order; every fourth labelled row is held for the calibration.  Only their
    features come to the driver.
    """
    by_hash = F.xxhash64(F.col("_id").cast("string"))
    known = (labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y"))
             .filter("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y")))
    ids = docs.select(F.col(f"`{id_col}`").alias("_id")).filter("_id is not null")
    seeds = known.orderBy(by_hash, "_id").limit(fit_rows)
    pool = (ids.orderBy(by_hash.desc(), "_id").limit(pool_rows).distinct()
            .join(known, "_id", "left_anti").withColumn("_y", F.lit(-1)))
    chosen = seeds.unionByName(pool).dropDuplicates(["_id"])
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"),
                       *[F.col(f"`{c}`").cast("string").alias(f"_v{i}") for i, c in enumerate(meta_cols)])
    rows = rows.join(F.broadcast(chosen), "_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [[*(p.tobytes() for view in both for p in (view[0], view[1])), *(np.array(v[2]).tobytes() for v in both)]
                   for both in _views(batch, len(meta_cols))]
            key = pa.array([str(x) for x in batch.column("_id").to_pylist()])
            yield pa.RecordBatch.from_arrays([key, batch.column("_y"), *[pa.array([r[i] for r in raw], pa.binary())
                                                                         for i in range(6)]],
                                             names=["id", "y", "a", "b", "c", "d", "e", "f"])

    got = (rows.mapInArrow(features, "id string, y int, a binary, b binary, c binary, d binary, e binary, f binary")
           .toArrow().to_pydict())
    order = sorted(range(len(got["id"])), key=lambda i: (zlib.crc32(got["id"][i].encode()), got["id"][i], got["a"][i], got["b"][i]))
    y = np.array([got["y"][i] for i in order], int)
    held = (y >= 0) & (np.cumsum(y >= 0) % 4 == 0)
    if min((y[~held] == 1).sum(), (y[~held] == 0).sum(), (y[held] == 1).sum(), (y[held] == 0).sum()) == 0:
        return None
    made = []
    for k, size in ((0, WORDS + SHAPES), (1, VALUES)):
        made.append(View.of([(np.frombuffer(got["ac"[k]][i], np.int32), np.frombuffer(got["bd"[k]][i], np.float32),
                              np.frombuffer(got["ef"[k]][i], float).tolist()) for i in order], size))
    return co_train((made[0], made[1]), y, held, rounds, exchange, sure)


def score(spark: SparkSession, df: DataFrame, models: Models | None, text_col: str = "text",
          meta_cols: tuple[str, ...] = ("source", "lang"), threshold: float = 0.5,
          carry: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with ``text_score``, ``meta_score``, their combination ``score`` and ``kept``.

    The score blends the calibrated log-odds of both views.  A text without words has score 0.  Without models (no labels of
    both classes) every text with words has score 1.  Nothing is shuffled; the models (under 200 KB) are sent to the tasks.
    """
    sent = spark.sparkContext.broadcast(models)
    rows = packed(df, carry, _text=text_col, **{f"_v{i}": c for i, c in enumerate(meta_cols)})
    for i in range(len(meta_cols)):
        rows = rows.withColumn(f"_v{i}", F.col(f"_v{i}").cast("string"))
    schema = rows.select("_row").schema.add("_t", "double").add("_m", "double").add("_s", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = _views(batch, len(meta_cols))
            empty = np.array([len(v[0][0]) == 0 for v in both], bool)
            if sent.value is None or not both:
                t = m = s = np.ones(len(both))
            else:
                t, m, s = sent.value.chances(View.of([v[0] for v in both], WORDS + SHAPES),
                                             View.of([v[1] for v in both], VALUES))
            t, m, s = (np.where(empty, 0.0, x) for x in (t, m, s))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *map(pa.array, (t, m, s))],
                                             names=["_row", "_t", "_m", "_s"])

    return unpacked(rows.mapInArrow(run, schema), text_score=F.col("_t"), meta_score=F.col("_m"), score=F.col("_s"),
                    kept=F.col("_s") >= threshold)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, **fitting) -> DataFrame:
    """Train on the labelled documents and score all (see :func:`train` and :func:`score`).

    Null texts count as empty; null metadata is a value of its own; null ids and labels are not fitted on but scored.  Rows
    with equal text and metadata have equal scores.  An input column named like an output is replaced.
    """
    return score(spark, docs, train(spark, docs, labels, **fitting), carry=carry)
