"""Language identification with hyperdimensional profiles: letter vectors are bound to n-grams and bundled."""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.common import packed, unpacked

#: Components of a vector and seed of the letters' vectors; an n-gram has three letters.
DIMENSIONS, SEED = 1024, 20240
#: n-gram vectors that a task remembers before it starts afresh (1 KB each); nothing but time depends on it.
REMEMBERED = 40_000
#: n-grams that are counted at a time.
GRAMS_AT_ONCE = 300_000
#: Prediction for a text without letters.
UNDETERMINED = "und"
BLANK, BITS = 32, 21


@cache
def letter_table() -> np.ndarray:
    """Whether a code point is a letter or a mark on one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of each word of a text, with a blank on both sides of the word."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letter_table()[points]
    points = np.where(letter, points, BLANK)[letter | np.r_[True, letter[:-1]]]
    codes = (points[:-2] << 2 * BITS) | (points[1:-1] << BITS) | points[2:]
    return codes[points[1:-1] != BLANK]


class Space:
    """Random vectors of +1 and -1 for letters, and the vectors of n-grams and texts that are made from them."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.table = np.empty((256, dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        """The vector of a letter; it depends on the letter and the seed only."""
        if point not in self.letters:
            bits = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dimensions)
            self.letters[point] = (2 * bits - 1).astype(np.int8)
        return self.letters[point]

    def gram(self, code: int) -> np.ndarray:
        """An n-gram binds (multiplies) the vectors of its letters, each permuted (rotated) by its place."""
        a, b, c = code >> 2 * BITS, code >> BITS & (1 << BITS) - 1, code & (1 << BITS) - 1
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct n-grams, one a row."""
        if len(self.place) > REMEMBERED:
            self.place.clear()
        for code in codes.tolist():
            if code not in self.place:
                at = self.place[code] = len(self.place)
                if at == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[at] = self.gram(code)
        return self.table[[self.place[c] for c in codes.tolist()]].astype(np.float32)

    def bundle(self, codes: list[np.ndarray], owner: list[int], n: int) -> np.ndarray:
        """Sums of the vectors of n-grams for ``n`` owners; the counts of a block meet the vectors in one product."""
        out = np.zeros((n, self.dimensions))
        held: list[tuple[int, np.ndarray]] = []

        def close() -> None:
            rows = sorted({o for o, _ in held})
            at = {o: i for i, o in enumerate(rows)}
            distinct, inverse = np.unique(np.concatenate([c for _, c in held]), return_inverse=True)
            where = np.repeat([at[o] for o, _ in held], [len(c) for _, c in held]) * len(distinct) + inverse
            counts = np.bincount(where, minlength=len(rows) * len(distinct)).reshape(len(rows), -1).astype(np.float32)
            out[rows] += counts @ self.vectors(distinct)

        size = 0
        for o, c in zip(owner, codes):
            for i in range(0, len(c), GRAMS_AT_ONCE):
                held.append((o, c[i:i + GRAMS_AT_ONCE]))
                size += len(held[-1][1])
                if size >= GRAMS_AT_ONCE:
                    close()
                    held, size = [], 0
        if held:
            close()
        return out


_SPACES: dict[tuple, Space] = {}


def _space(*key) -> Space:
    """One space a Python worker."""
    if key not in _SPACES:
        _SPACES[key] = Space(*key)
    return _SPACES[key]


def profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS,
             seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype of each language: the unit vector of the bundle of all its texts.

    Each task bundles what it reads, so it hands on one vector a language; the driver holds one vector a language too (8 KB
    each).  Rows without a language or without letters teach nothing.
    """
    rows = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = _space(dimensions, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            at = {lang: i for i, lang in enumerate(names)}
            for i in range(0, len(langs), 64):
                texts = batch.column("text").slice(i, 64).to_pylist()
                part = space.bundle([grams(t) for t in texts], [at[x] for x in langs[i:i + 64]], len(names))
                for lang, v in zip(names, part):
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "i": list(range(dimensions)), "x": v.round().astype(int)},
                                             schema=pa.schema([("lang", pa.string()), ("i", pa.int32()), ("x", pa.int64())]))

    sums = (rows.filter("lang is not null and text is not null").mapInArrow(run, "lang string, i int, x long")
            .groupBy("lang", "i").agg(F.sum(F.col("x").cast("decimal(38, 0)")).cast("double").alias("x")).toPandas())
    out = {}
    for lang, part in sums.groupby("lang"):
        v = np.zeros(dimensions)
        v[part["i"].to_numpy()] = part["x"].to_numpy()
        if v.any():
            out[lang] = v / np.linalg.norm(v)
    return out


def identify(spark: SparkSession, df: DataFrame, learned: dict[str, np.ndarray], text_col: str = "text",
             dimensions: int = DIMENSIONS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with ``lang_pred`` and ``score``: the nearest prototype by cosine, and that cosine (0 to 1).

    The mean of the prototypes, what all languages share, is taken from both sides before the cosine where there are two or
    more.  Of equally near prototypes the first by name is taken.  A null text, one without letters, or any text when
    nothing was learned is ``und`` with score 0.  Nothing is shuffled; the prototypes (8 KB a language) are sent to the tasks.
    An input column named like an output is replaced.  ``carry`` names the input columns to return (default: all).
    """
    names = sorted(learned)
    matrix = np.array([learned[n] for n in names])
    mean = matrix.mean(0) if len(names) > 1 else np.zeros(dimensions)
    sent = spark.sparkContext.broadcast((matrix, mean))
    rows = packed(df, carry, _text=text_col)
    schema = rows.select("_row").schema.add("_lang", "string").add("_score", "double")

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, (prototypes, shared) = _space(dimensions, seed), sent.value
        prototypes = unit(prototypes - shared) if names else prototypes
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                codes = [grams(t or "") for t in part.column("_text").to_pylist()]
                n = len(codes)
                known = np.array([len(c) > 0 for c in codes], bool) & bool(names)
                cosines = (unit(unit(space.bundle(codes, list(range(n)), n)) - shared) @ prototypes.T if names
                           else np.zeros((n, 1)))
                best = cosines.argmax(1)
                langs = [names[b] if k else UNDETERMINED for b, k in zip(best, known)]
                scores = np.where(known, np.clip(cosines[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["_row", "_lang", "_score"])

    return unpacked(rows.mapInArrow(run, schema), lang_pred=F.col("_lang"), score=F.col("_score"))
