"""Toxicity by a chain of linear classifiers trained on out-of-fold probabilities."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm.common import text_and_id, write_table

#: Labelled documents to learn from, about; features of each category; folds; least documents and least chi-square of a feature.
SAMPLE, FEATURES, FOLDS, LEAST, LEAST_CHI = 10_000, 2048, 3, 5, 25
#: Ridge penalty of the linear models, and the probability from which a document is rejected.
RIDGE, REJECT = 0.02, 0.1
#: Character n-grams inside a word with its two ends marked.
SHORTEST, LONGEST = 3, 5
#: Rows of the matrix of features that are widened at once.
ROWS = 500
#: Words whose chosen features, and whose features at all, a task remembers.
CACHE, COUNT_CACHE = 100_000, 20_000

_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words and runs of symbols of a whole text."""
    return set(_TOKEN.findall(text.lower())) if text else set()


def features_of(token: str) -> Iterator[str]:
    """The token itself with its ends marked, and for words the n-grams in that; one after another, however long it is."""
    marked = f"<{token}>"
    yield marked
    if token[0].isalpha():
        yield from (marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1) if n < len(marked))


class Seen:
    """Maps texts to the sorted ids of the chosen features they hold."""

    def __init__(self, ids: dict[str, int]):
        self.ids, self.known = ids, {}

    def __call__(self, text: str | None) -> list[int]:
        found: set[int] = set()
        if len(self.known) > CACHE:
            self.known.clear()
        for t in tokens(text):
            got = self.known.get(t)
            if got is None:
                got = self.known[t] = tuple({self.ids[f] for f in features_of(t) if f in self.ids})
            if got:
                found.update(got)
        return sorted(found)


def matrix(rows: list[list[int]], n_features: int) -> np.ndarray:
    """Documents by features, 0 or 1."""
    x = np.zeros((len(rows), n_features), np.uint8)
    for i, r in enumerate(rows):
        x[i, r] = 1
    return x


def _bits(found: list[int], n_features: int) -> bytes:
    """A document's row of the matrix, eight features a byte."""
    return np.packbits(matrix([found], n_features)[0]).tobytes()


def _times_bits(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    """:func:`_times` of a packed matrix, which is never unpacked whole."""
    return np.concatenate([np.empty(0), *(_times(np.unpackbits(bits[s : s + ROWS], axis=1, count=len(v)), v) for s in range(0, len(bits), ROWS))])


def _times(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``x @ v`` of a 0 or 1 matrix held in bytes, by blocks of rows."""
    v = v.astype(np.float32)
    return np.concatenate([np.empty(0), *(x[s : s + ROWS].astype(np.float32) @ v for s in range(0, len(x), ROWS))])


def _back(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``r @ x`` likewise."""
    r, out = r.astype(np.float32), np.zeros(x.shape[1])
    for s in range(0, len(x), ROWS):
        out += r[s : s + ROWS] @ x[s : s + ROWS].astype(np.float32)
    return out


def fit_linear(x: np.ndarray, extra: np.ndarray, y: np.ndarray, ridge: float = RIDGE, of: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression on features ``x``, ``extra`` columns and an intercept.

    Newton steps, each solved by conjugate gradients. Returns the weights of the features,
    the extra columns and the intercept (not penalised). Only rows marked in ``of`` count,
    so that a fold needs no copy of ``x``.
    """
    n, dense = x.shape[1], np.hstack([extra, np.ones((len(y), 1))])
    of = np.ones(len(y)) if of is None else of.astype(float)
    penalty = np.r_[np.full(n + extra.shape[1], ridge), 1e-6]
    w = np.zeros(n + dense.shape[1])
    share = np.clip((y @ of) / of.sum() if of.any() else 0.5, 1e-3, 1 - 1e-3)
    w[-1] = math.log(share / (1 - share))
    times = lambda v: _times(x, v[:n]) + dense @ v[n:]
    back = lambda r: np.r_[_back(x, r), r @ dense]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        gradient = back(of * (y - p)) - penalty * w
        if np.abs(gradient).max() < 1e-3:
            break
        h = of * (p * (1 - p) + 1e-9)
        step, r = np.zeros_like(w), gradient.copy()
        d, rr = r.copy(), r @ r
        for _ in range(25):
            hd = back(h * times(d)) + penalty * d
            a = rr / (d @ hd)
            step, r = step + a * d, r - a * hd
            if (new := r @ r) < 1e-6 * (1e-3 + gradient @ gradient):
                break
            d, rr = r + (new / rr) * d, new
        w = w + step
    return w


def fit_models(spark: SparkSession, bits: np.ndarray, n_features: int, extra: np.ndarray, y: np.ndarray, of: list[np.ndarray]) -> list[np.ndarray]:
    """:func:`fit_linear` on the rows marked in each of ``of``: every model is fitted in a task of its own.

    The sample goes to the tasks as bits, a few MB at most by the bounds on its documents and features.
    """
    sent = spark.sparkContext.broadcast((bits, n_features, extra, y, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, n, extra, y, of = sent.value
        for b in batches:
            for k in b.column(0).to_pylist():
                w = fit_linear(np.unpackbits(bits, axis=1, count=n), extra, y, of=of[k])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([w.tolist()], pa.list_(pa.float64()))], ["id", "w"])

    got = {r["id"]: np.array(r["w"]) for r in spark.range(0, len(of), 1, len(of)).mapInArrow(run, "id long, w array<double>").collect()}
    sent.destroy()
    return [got[k] for k in range(len(of))]


class Chain:
    """Fitted chain: for each category its weights on features, earlier probabilities and 1."""

    def __init__(self, categories: list[str], ids: dict[str, int], weights: list[np.ndarray | None]):
        self.categories, self.ids, self.weights = categories, ids, weights

    def probabilities(self, found: list[int]) -> list[float]:
        out: list[float] = []
        n = len(self.ids)
        for w in self.weights:
            if w is None:
                out.append(0.0)
                continue
            z = float(w[found].sum() + w[-1]) + sum(x * p for x, p in zip(w[n:], out))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, features: int = FEATURES) -> Chain:
    """Fits the chain, in the order of ``categories`` (name: Boolean column of ``labels``).

    Learns from about ``sample`` labelled documents (picked by a hash of the id), whole
    texts. The features of a category are the ``features`` words and character n-grams with the
    largest chi-square among those documents. A later model is trained on the earlier
    categories' probabilities from models that did not see the document (FOLDS folds). A
    category's model and those of its folds are fitted side by side, each in a task. A
    category without a labelled example (or without any label) has probability 0.

    Null ids and labels with a null in a category teach nothing; of a repeated doc_id's
    labels any 1 counts, and of its documents the one with the smallest text (null last)
    teaches, so the sample's bound holds for rows too.
    """
    names = list(categories)
    marked = labels.select(F.col("doc_id"), *[categories[c].cast("int").alias(f"y{k}") for k, c in enumerate(names)]).where("doc_id is not null").groupBy("doc_id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))])
    marked = marked.dropna()
    n = marked.count()
    spread = 1 << 30
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < int(spread * min(1.0, sample / max(1, n))))
    ys = [f"y{k}" for k in range(len(names))]
    rows, _ = write_table(text_and_id(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").groupBy("doc_id", *ys).agg(F.min("text").alias("text")).select("doc_id", "text", *ys), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}

        def remembered(token: str) -> Iterable[str]:
            if len(token) > 80:
                return features_of(token)
            got = known.get(token)
            if got is None:
                if len(known) >= COUNT_CACHE:
                    known.clear()
                got = known[token] = tuple(features_of(token))
            return got

        for b in batches:
            seen = [Counter() for _ in range(1 + len(ys))]
            y = [c.to_pylist() for c in b.columns[2:]]
            for i, text in enumerate(b.column(1)):
                found: set[str] = set()
                found.update(*map(remembered, tokens(text.as_py())))
                for k, c in enumerate(seen):
                    if k == 0 or y[k - 1][i]:
                        c.update(found)
            all_ = list(seen[0])
            yield pa.RecordBatch.from_arrays([pa.array(all_, pa.string()), *(pa.array([c[f] for f in all_], pa.int64()) for c in seen)], ["feature", "n", *ys])

    schema = "feature string, n long" + "".join(f", {y} long" for y in ys)
    counted, _ = write_table(rows.mapInArrow(count, schema).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *ys)]).where(f"n >= {LEAST}"), "features")
    total, *with_y = rows.agg(F.count("*"), *[F.coalesce(F.sum(y), F.lit(0)) for y in ys]).first()
    chosen: dict[str, int] = {}
    for y, pos in zip(ys, with_y):
        expect = F.col("n") * (pos / max(1, total))
        chi = (F.col(y) - expect) ** 2 / (expect + 1e-9) + (F.col(y) - expect) ** 2 / (F.col("n") - expect + 1e-9)
        for r in counted.select("feature", chi.alias("chi")).where(f"chi >= {LEAST_CHI}").orderBy(F.desc("chi"), "feature").limit(features).collect():
            chosen.setdefault(r["feature"], len(chosen))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(chosen)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_bits(seen(t.as_py()), len(chosen)) for t in b.column(1)], pa.binary()), *b.columns[2:]], ["doc_id", "found", *ys])

    got = rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found binary" + "".join(f", {y} int" for y in ys)).toPandas()
    got = got.sort_values("doc_id", kind="stable").reset_index(drop=True)
    # The driver keeps the sample as bits: its bytes, and the lists they came from, are many times as large.
    bits = np.frombuffer(b"".join(got.pop("found")), np.uint8).reshape(len(got), (len(chosen) + 7) // 8)
    fold = np.arange(len(bits)) % FOLDS
    earlier, weights = np.empty((len(bits), 0)), []
    for k, y in enumerate(ys):
        target = got[y].to_numpy(float)
        if not target.any():
            weights.append(None)
            earlier = np.hstack([earlier, np.zeros((len(bits), 1))])
            continue
        last = k + 1 == len(ys)
        whole, *parts = fit_models(docs.sparkSession, bits, len(chosen), earlier, target, [np.ones(len(bits), bool), *(fold != f for f in range(0 if last else FOLDS))])
        weights.append(whole)
        if not last:
            out = np.zeros(len(bits))
            for f, w in enumerate(parts):
                z = _times_bits(bits, w[: len(chosen)]) + earlier @ w[len(chosen) : -1] + w[-1]
                out[fold == f] = 1 / (1 + np.exp(-np.clip(z[fold == f], -30, 30)))
            earlier = np.hstack([earlier, out[:, None]])
    return Chain(names, chosen, weights)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``p_<category>`` of each row, from the whole text.

    Null and empty texts have no features and so the intercept's probability; repeated rows
    and null ids stay; other columns are not read.
    """
    df = text_and_id(docs, id_col, text_col)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(chain.ids)
        for b in batches:
            p = [chain.probabilities(seen(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in p], pa.float64()) for k in range(len(names)))], ["doc_id", *names])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}" + "".join(f", {n} double" for n in names))



def default_categories() -> dict[str, Column]:
    """The labelled categories in the chain's order: low quality, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def rejected(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents of ``docs`` to reject: ``doc_id, p_low_quality, p_toxic`` with p_toxic >= ``reject``.

    Without a document labelled toxic nothing is rejected. Null and empty texts have no
    features and are judged by the intercept; texts of any length are judged whole; equal texts have equal probabilities, so all or
    none of them go; rows with repeated or null ids are judged one by one; an empty table
    gives an empty result; other columns of either table are not read.
    """
    return score(docs, learn(docs, labels, default_categories())).where(F.col("p_toxic") >= reject)
