"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each has a logistic model over hashed
features of a text's distinct words, and the probabilities of the categories before
it are further features. While training, those probabilities are out-of-fold: each
row's come from models that have not seen it, as it will be for new texts.

Features are each distinct word and its starts of ``PREFIXES`` letters, of words that
are as long. A model is fitted
on a sample of at most ``MAX_ROWS`` labelled rows, half of them positive for the last
category where there are so many, chosen by hash; the intercept is then moved from
the sample's share of positives to the table's. All else covers every row: each text
is scored whole, in one pass, by weights of a fixed size.

Defined results: a null or empty text has no features and gets the base rates. A
labelled row whose category is null is left out of the fit. Without labelled rows of
both kinds a category has its base rate for all texts (0 without any). Rows that
share an id are scored each for itself. Other columns pass through :func:`apply`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship
from .words import alnum_words

#: Categories in the order of the chain, as SQL over the labels.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
MAX_ROWS = 8_000
#: Words whose features a scorer keeps; the table is begun anew beyond it.
TABLE_WORDS = 200_000
FOLDS = 3
FEATURES = 1 << 18
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.4
STEPS, RATE = 200, 0.05
RIDGE = 1e-4
#: A feature counts if so many rows of the sample have it, and if its share of positives is so many standard errors off.
MIN_ROWS, MIN_Z = 3, 4.0


def _of_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features, and the number of the word that each comes from."""
    import xxhash

    text = [w.decode() for w in words]
    hashed = [(xxhash.xxh32_intdigest(w), k) for k, w in enumerate(words)]
    hashed += [(xxhash.xxh32_intdigest(w[:n], n), k) for n in PREFIXES for k, w in enumerate(text) if len(w) >= n]
    both = np.array(hashed, np.int64).reshape(-1, 2)
    return both[:, 0] & (FEATURES - 1), both[:, 1]


def features(text: str | None) -> np.ndarray:
    """Hashed features of the distinct words, each once."""
    return np.unique(_of_words(list(set(alnum_words(text))))[0])


class Linear:
    """A logistic model over hashed features and a few dense ones."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float) -> None:
        self.weights, self.dense, self.bias = weights, dense, bias

    @staticmethod
    def fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> "Linear":
        """Full-batch Adam on the mean log loss with a ridge."""
        n = len(rows)
        if not n or y.min() == y.max():
            rate = float(y.mean()) if n else 0.0
            return Linear(np.zeros(FEATURES, np.float32), np.zeros(dense.shape[1]), _logit(rate))
        # features that tell the kinds apart; words of one or two texts would only be learnt by heart
        pos, held = np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32)
        for r, v in zip(rows, y):  # each feature is there once a row
            held[r] += 1
            if v:
                pos[r] += 1
        rate = y.mean()
        z = (pos / np.maximum(held, 1) - rate) * np.sqrt(np.maximum(held, 1) / (rate * (1 - rate)))
        telling = (held >= MIN_ROWS) & (np.abs(z) >= MIN_Z)
        few = [r[telling[r]] for r in rows]
        used, at = np.unique(np.concatenate(few), return_inverse=True)
        row = np.repeat(np.arange(n), [len(r) for r in few])
        w = np.zeros(len(used) + dense.shape[1] + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        k = len(used)
        for step in range(1, STEPS + 1):
            z = np.bincount(row, w[at], n) + dense @ w[k:-1] + w[-1]
            e = (_sigmoid(z) - y) / n
            g = np.concatenate([np.bincount(at, e[row], k), dense.T @ e, [e.sum()]])
            g[:-1] += RIDGE * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        out = np.zeros(FEATURES, np.float32)
        out[used] = w[:k]
        return Linear(out, w[k:-1], float(w[-1]))

    def predict(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        z = np.array([self.weights[r].sum(dtype=np.float64) for r in rows])
        return _sigmoid(z + dense @ self.dense + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


class Chain:
    """Models of the categories in order."""

    def __init__(self, names: list[str], models: list[Linear]) -> None:
        self.names, self.models = names, models

    @staticmethod
    def fit(names: list[str], rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, rates: list[float]) -> "Chain":
        """labels: a column a category, nan where unknown; rates: the table's share of positives."""
        models: list[Linear] = []
        seen = np.zeros((len(rows), 0))  # out-of-fold probabilities of the categories before
        for j in range(len(names)):
            y = labels[:, j]
            ok = ~np.isnan(y)

            def fitted(use: np.ndarray) -> Linear:
                own = np.flatnonzero(use & ok)
                model = Linear.fit([rows[i] for i in own], seen[own], y[own])
                if len(own):
                    model.bias += _logit(rates[j]) - _logit(float(y[own].mean()))
                return model

            models.append(fitted(np.ones(len(rows), bool)))
            out = np.zeros(len(rows))
            for k in range(FOLDS):
                held = folds == k
                at = np.flatnonzero(held)
                out[at] = fitted(~held).predict([rows[i] for i in at], seen[at])
            seen = np.column_stack([seen, out])
        return Chain(names, models)

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        seen = np.zeros((len(rows), 0))
        for model in self.models:
            seen = np.column_stack([seen, model.predict(rows, seen)])
        return seen


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit a chain on a bounded sample of the documents that ``labels`` names."""
    ship(docs.sparkSession)
    categories = categories or CATEGORIES
    names = list(categories)
    marked = labels.select(F.col(id_col).cast("long").alias("__gl_doc"), *[F.expr(e).cast("double").alias(n) for n, e in categories.items()]).dropDuplicates(["__gl_doc"]).filter("__gl_doc is not null")
    rates = marked.agg(*[F.avg(n).alias(n) for n in names]).first()
    order = F.xxhash64("__gl_doc")
    # the first max_rows / 2 by hash of each kind; a bounded number of rows, sent to all tasks
    kinds = [marked.filter(F.coalesce(F.col(names[-1]), F.lit(0.0)) == k).orderBy(order).limit(max_rows // 2) for k in (0.0, 1.0)]
    sample = kinds[0].union(kinds[1])
    rows = docs.select(F.col(id_col).cast("long").alias("__gl_doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "__gl_doc")
    first = rows.dropDuplicates(["__gl_doc"]).select("__gl_doc", *names, "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1 + len(names))), at], ["__gl_doc", *names, "at"])

    got = first.mapInArrow(released(extract), "__gl_doc long, " + ", ".join(f"{n} double" for n in names) + ", at array<int>").toArrow().combine_chunks().sort_by("__gl_doc")
    folds = got["__gl_doc"].to_numpy() % FOLDS
    known = np.column_stack([got[n].to_numpy() for n in names]).astype(float) if len(got) else np.zeros((0, len(names)))
    lists = [x for c in got["at"].chunks for x in np.split(c.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(c).to_numpy())[:-1])] if len(got) else []
    return Chain.fit(names, lists, known, folds, [rates[n] or 0.0 for n in names])


class _Scorer:
    """Probabilities of many texts; the features of words that weigh anything are kept while the words are not too many."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        self.weigh = np.any([m.weights != 0 for m in chain.models], axis=0)
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        known, rows = self.known, []
        for text in texts:
            own = set(alnum_words(text.as_py()))
            new = [w for w in own if w not in known]
            if new:
                if len(known) > TABLE_WORDS:
                    known.clear()
                    new = list(own)
                known.update(dict.fromkeys(new, ()))
                at, word = _of_words(new)
                hit = self.weigh[at]
                for f, k in zip(at[hit].tolist(), word[hit].tolist()):
                    known[new[k]] += (f,)
            rows.append(np.array(list({f for w in own for f in known[w]}), np.int64))
        return self.chain.predict(rows)


def scores(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> of each, rejected): rejected by the last category."""
    names, sent = chain.names, docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(sent.value)
        for batch in batches:
            p = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(len(names))), pa.array(p[:, -1] >= threshold)], ["doc_id", *(f"p_{n}" for n in names), "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", rejected boolean")


def apply(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows, in the pass that scores them."""
    chain = train(docs, labels, id_col=id_col, text_col=text_col)
    sent, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at))[:, -1] < threshold))

    return docs.mapInArrow(released(run), docs.schema)
