"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over words; each model also gets the
earlier categories' probabilities. For training, those come out of fold: from models that haven't
seen the row, as the chain won't have seen the rows that it is used on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import apart, held, over_texts, quoted, release, slices

#: Labelled rows that the chain is fitted on at most, those of the smallest hashes.
LABELLED_ROWS = 8_000
#: Buckets that words are hashed to.
BUCKETS = 1 << 20
#: Characters of the beginnings of words that are features besides the words.
BEGINNINGS = (4, 5, 6)
#: Words of the sample that a model gets, those that tell its category best.
FEATURES = 4_096
#: Rows of the sample in which a word must stand.
LEAST_ROWS = 4
FOLDS, STEPS, DECAY = 3, 150, 3e-3
#: Bias of a model without examples.
NEVER = -30.0
#: Words are kept with their weights; beyond so many the memory starts anew.
REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def parts(word: str) -> list[str]:
    """The word, and beginnings that it shares with others."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if n < len(word))]


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's distinct words in lower case and of their beginnings."""
    return np.unique(np.fromiter((bucket(p) for w in set(WORD.findall((text or "").lower())) for p in parts(w)), np.int32))


@dataclass(frozen=True)
class Model:
    category: str
    words: dict[int, float]
    bias: float
    earlier: tuple[float, ...]


@dataclass(frozen=True)
class Chain:
    """Models in the order of prediction; key tells chains apart in workers."""

    models: tuple[Model, ...]
    key: int

    @property
    def categories(self) -> list[str]:
        return [m.category for m in self.models]


class Rows:
    """Sets of features as one sparse matrix of ones, restricted to chosen columns."""

    def __init__(self, sets: list[np.ndarray], columns: np.ndarray):
        place = np.full(BUCKETS, -1, np.int32)
        place[columns] = np.arange(len(columns), dtype=np.int32)
        found = [p[p >= 0] for p in (place[s] for s in sets)]
        self.row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(f) for f in found])
        self.column = np.concatenate([*found, np.zeros(0, np.int32)])
        self.shape = len(sets), len(columns)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.shape[0])

    def dot_t(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row], self.shape[1])


def probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chosen(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Features with the largest log odds between the classes, weighed by how often they stand."""
    everywhere = np.concatenate([*sets, np.zeros(0, np.int32)])
    there = np.bincount(everywhere, minlength=BUCKETS)
    inside = np.bincount(np.concatenate([*(s for s, y in zip(sets, labels) if y), np.zeros(0, np.int32)]), minlength=BUCKETS)
    n, n_inside = len(labels), labels.sum()
    expected = there * (n_inside / max(n, 1))
    score = np.where(there >= LEAST_ROWS, (inside - expected) ** 2 / np.maximum(expected, 1e-9), -1)
    order = np.argsort(-score, kind="stable")[:FEATURES]
    return order[score[order] >= 0]


def fit(sets: list[np.ndarray], labels: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(columns, their weights, bias, weights of the earlier categories) by logistic regression with weight decay, Adam steps over all rows."""
    columns = chosen(sets, labels)
    rows, n = Rows(sets, columns), max(len(labels), 1)
    size = len(columns) + 1 + earlier.shape[1]
    weights, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    weights[len(columns)] = np.log((labels.sum() + 1) / (n - labels.sum() + 1))
    for step in range(1, STEPS + 1):
        word, bias, early = np.split(weights, [len(columns), len(columns) + 1])
        error = (probability(rows.dot(word) + bias + earlier @ early) - labels) / n
        slope = np.concatenate([rows.dot_t(error) + DECAY * word / np.sqrt(n), [error.sum()], earlier.T @ error])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights = weights - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    word, bias, early = np.split(weights, [len(columns), len(columns) + 1])
    return columns, word, float(bias[0]), early


def applied(sets: list[np.ndarray], model: tuple, earlier: np.ndarray) -> np.ndarray:
    columns, word, bias, early = model
    return probability(Rows(sets, columns).dot(word) + bias + earlier @ early)


def train(sets: list[np.ndarray], labels: dict[str, np.ndarray]) -> Chain:
    """A chain over the categories in the order given; folds are by position.

    A category of which there is no example is never predicted.
    """
    fold = np.arange(len(sets)) % FOLDS
    earlier, models = np.zeros((len(sets), 0)), []
    for i, (category, wanted) in enumerate(labels.items()):
        columns, word, bias, early = fit(sets, wanted, earlier) if wanted.any() else (np.zeros(0, int), np.zeros(0), NEVER, np.zeros(i))
        models.append(Model(category, {int(c): float(w) for c, w in zip(columns, word) if w}, bias, tuple(map(float, early))))
        if i + 1 < len(labels):
            outside = np.zeros(len(sets))
            for f in range(FOLDS):
                inside, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if wanted[inside].any():
                    model = fit([sets[j] for j in inside], wanted[inside], earlier[inside])
                    outside[out] = applied([sets[j] for j in out], model, earlier[out])
            earlier = np.column_stack([earlier, outside])
    return Chain(tuple(models), zlib.crc32(repr(models).encode()))


def train_on(docs: DataFrame, labels: DataFrame, categories: dict[str, str], labelled_rows: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit a chain on at most labelled_rows of the labelled rows; categories: name and SQL condition over labels.

    The sample is bounded, so it is broadcast, and only its features, not its texts, come to the driver.
    Of documents that repeat an id, the smallest text stands for it, so one row an id comes at most.
    Labels without an id, or whose id no document has, are left out; null labels are no.
    """
    wanted = [F.coalesce(F.expr(sql), F.lit(False)).alias(f"__y{i}") for i, sql in enumerate(categories.values())]
    rows = labels.where(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).alias("__id"), *wanted).groupBy("__id").agg(*[F.max(f"__y{i}").alias(f"__y{i}") for i in range(len(wanted))])
    sample = rows.orderBy(F.xxhash64("__id"), "__id").limit(labelled_rows)
    texts = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text")).join(F.broadcast(sample), "__id")
    names = [f"__y{i}" for i in range(len(wanted))]
    texts = texts.groupBy("__id").agg(F.min("__text").alias("__text"), *[F.first(n).alias(n) for n in names])
    made = over_texts(texts, ["__id", *names], "__text", "words array<int>", lambda ts: ((features(t).tolist(),) for t in ts)).toArrow()
    made = made.sort_by([("__id", "ascending")]).combine_chunks()
    words = pa.concat_arrays(made["words"].chunks) if made.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, bounds = words.values.to_numpy(), words.offsets.to_numpy()
    sets = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
    wanted = {c: np.array(made[n].to_pylist(), float) for c, n in zip(categories, names)}
    chain = train(sets, wanted)
    del made, words, flat, sets
    release()  # the driver goes on to other work
    return chain


class Weights(dict):
    """Buckets of each word that any model has a weight for, looked up when first asked for."""

    def __init__(self, chain: Chain):
        super().__init__()
        n = len(chain.models)
        self.buckets: dict[int, tuple[float, ...]] = {}
        for i, model in enumerate(chain.models):
            for b, w in model.words.items():
                self.buckets[b] = tuple(w if j == i else x for j, x in enumerate(self.buckets.get(b, (0.0,) * n)))

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[word] = tuple(b for b in map(bucket, parts(word)) if b in self.buckets)
        return made


def predict(text: str | None, chain: Chain) -> list[float]:
    """Probabilities of the chain's categories for a whole text."""
    known = held(("toxicity", chain.key), lambda: Weights(chain))
    hits = set().union(*map(known.__getitem__, set(WORD.findall((text or "").lower()))))
    found = [known.buckets[b] for b in sorted(hits)]
    out: list[float] = []
    for i, model in enumerate(chain.models):
        x = model.bias + sum(w[i] for w in found) + sum(a * b for a, b in zip(model.earlier, out))
        out.append(float(probability(np.float64(x))))
    return out


def score(docs: DataFrame, chain: Chain, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """docs with a column of each category's probability, of the names given; one pass, no shuffle.

    A null text counts as empty and gets what a text without known words gets; texts of any length
    are scored whole. All columns are kept but those of the very names that are made, which are
    replaced. Repeated rows each stay; an empty table gives no rows.
    """
    names = names or [c + "_probability" for c in chain.categories]
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, *[StructField(name, DoubleType()) for name in names]])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [predict(t, chain) for t in part.column(place).to_pylist()]
                columns = list(zip(*made)) if made else [()] * len(names)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.float64()) for c in columns]], names=schema.names)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)


#: Categories of the table labels in the order of the chain: texts that aren't wanted for their
#: quality first, toxic ones then.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
#: Probability from which a document is toxic.
THRESHOLD = 0.3


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs with low_quality_probability, toxic_probability and toxic (boolean), by a chain fitted on labels.

    Columns of these three names that docs has are replaced. Null, long and repeated rows are as in
    score(); without labels, or with an empty table of documents, nothing is toxic.
    """
    chain = train_on(docs, labels, CATEGORIES, id_col=id_col, text_col=text_col)
    return score(docs, chain, text_col).withColumn("toxic", F.col("toxic_probability") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the chain, fitted on labels, doesn't call toxic; all columns kept, whatever their names.

    Null texts stay, as do all rows where there are no labels; repeated rows are judged each; an
    empty table gives no rows.
    """
    chain = train_on(docs, labels, CATEGORIES, id_col=id_col, text_col=text_col)
    names = [apart(docs, f"{c}_probability") for c in chain.categories]
    kept = score(docs, chain, text_col, names).where(F.col(names[chain.categories.index("toxic")]) < threshold)
    return kept.drop(*names)
