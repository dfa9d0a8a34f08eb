"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import stored, table

#: Labelled rows that the model is fitted on at most, by the hash of their id; the bound of all that reaches the driver.
SAMPLE_ROWS = 16_000
#: Words and word beginnings that the linear classifier knows at most, and the strongest of them that vote by themselves.
FEATURES = 4_000
VOTERS = 96
#: How much likelier a feature must be in toxic documents, and the least G of its counts: some 10^5 rare words are tried,
#: of which chance alone gives a handful a G of 16.
MIN_LIFT = 4.0
MIN_G = 16.0
#: A document with this score or more counts as toxic.
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are never read. A null id has no label and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def word_features(word: str) -> list[str]:
    """A lexicon entry (the word) and two patterns (words that begin alike)."""
    out = ["=" + word]
    return out + ["^" + word[:n] for n in (4, 5) if len(word) >= n]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


# ---- the label model -----------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """A latent label with voters that fire more or less often under either value.

    ``fit`` runs expectation maximisation over the votes (rows x voters, 1 fires, 0 abstains) and the annotators' vote
    (1, 0 or -1 for none), whose own accuracy is estimated too. Voters that fire together beyond what the label explains
    are correlated; each one's weight is divided by one plus its positive correlations, so that ten spellings of one
    hint count as one.
    """

    prior: float = 0.1
    rates: np.ndarray | None = None
    shares: np.ndarray | None = None
    correlations: np.ndarray | None = None
    annotator: np.ndarray | None = None

    def fit(self, votes: np.ndarray, notes: np.ndarray, rounds: int = 25) -> LabelModel:
        q = np.where(notes < 0, 0.1, np.clip(notes, 0.05, 0.95))
        self.shares = np.ones(votes.shape[1])
        for _ in range(rounds):
            self.prior = float(np.clip(q.mean(), 1e-4, 1 - 1e-4))
            weights = np.stack([1 - q, q])
            self.rates = (weights @ votes + 0.05) / (weights.sum(axis=1, keepdims=True) + 1.0)
            noted = notes >= 0
            self.annotator = np.array([(w[noted] @ (notes[noted] == 1) + a) / (w[noted].sum() + 10.0) for w, a in zip(weights, (0.2, 9.8))])
            self.correlations = self._residual(votes, weights)
            self.shares = 1 / (1 + np.clip(self.correlations, 0, 1).sum(axis=0))
            new = self.posterior(votes, notes)
            if np.abs(new - q).max() < 1e-4:
                break
            q = new
        return self

    def _residual(self, votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Correlation of each pair of voters within a label value, averaged over the values."""
        total, cov, var = weights.sum(), 0, 0
        for w, rate in zip(weights, self.rates):
            centred = votes - rate
            cov = cov + (centred * w[:, None]).T @ centred / total
            var = var + w.sum() / total * rate * (1 - rate)
        out = cov / np.sqrt(np.outer(var, var) + 1e-12)
        np.fill_diagonal(out, 0)
        return out

    def posterior(self, votes: np.ndarray, notes: np.ndarray) -> np.ndarray:
        low, high = np.clip(self.rates, 1e-5, 1 - 1e-5)
        on, off = np.log(high / low) * self.shares, np.log((1 - high) / (1 - low)) * self.shares
        logit = np.log(self.prior / (1 - self.prior)) + votes @ on + (1 - votes) @ off
        clean, toxic = np.clip(self.annotator, 1e-3, 1 - 1e-3)
        logit += np.where(notes < 0, 0, np.where(notes == 1, np.log(toxic / clean), np.log((1 - toxic) / (1 - clean))))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_linear(rows: list[np.ndarray], q: np.ndarray, n_features: int, l2: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on the presence of features, by accelerated gradient steps."""
    lengths = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows)), lengths)
    feature = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    scale = np.sqrt(np.maximum(np.bincount(feature, minlength=n_features), 1) / len(rows))
    w = v = np.zeros(n_features)
    b = vb = float(np.log(np.clip(q.mean(), 1e-4, 0.5) / (1 - np.clip(q.mean(), 1e-4, 0.5))))
    step = 4.0 / max(1.0, float(lengths.max(initial=1)))
    for k in range(rounds):
        z = np.bincount(doc, (v / scale)[feature] if len(feature) else None, minlength=len(rows)) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) / len(rows)
        nw = v - step * (np.bincount(feature, g[doc], minlength=n_features) / scale + l2 * v)
        nb = vb - step * g.sum()
        v, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w / scale, b


# ---- fitting and scoring on Spark ----------------------------------------------------------------------------


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(y, t) of up to ``rows`` labelled rows that are not held out; the ids are bounded and so may be broadcast."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("y", F.col(text_col).alias("t"))


def _mined(sample: DataFrame, limit: int) -> list[str]:
    """The features that tell toxic from clean documents best, strongest first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, docs = [Counter(), Counter()], [0, 0]
        for pdf in batches:
            for y, t in zip(pdf["y"], pdf["t"]):
                n[y].update(text_features(t))
                docs[y] += 1
        names = list(n[0].keys() | n[1].keys())
        yield pd.DataFrame({"f": ["", *names], "clean": [docs[0], *(n[0][f] for f in names)], "toxic": [docs[1], *(n[1][f] for f in names)]})

    counts = sample.mapInPandas(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stored(counts)
    total = counts.where("f = ''").first()
    if not total or not total["clean"] or not total["toxic"]:
        return []
    base = total["toxic"] / (total["toxic"] + total["clean"])
    p, n = (F.col("toxic") + 0.5) / (total["toxic"] + 1), (F.col("clean") + 0.5) / (total["clean"] + 1)
    seen = F.col("toxic") + F.col("clean")

    def part(k: str, share: float) -> Column:
        return F.when(F.col(k) > 0, 2 * F.col(k) * F.log(F.col(k) / (seen * share))).otherwise(0.0)

    g = part("toxic", base) + part("clean", 1 - base)
    top = counts.where((F.col("f") != "") & (p / n >= MIN_LIFT) & (g >= MIN_G)).orderBy(g.desc(), "f").limit(limit)
    return [r["f"] for r in top.select("f").collect()]


@dataclass
class Model:
    """What scoring needs: the weight of each known feature and the constant."""

    weights: dict[str, float]
    constant: float

    def score(self, features: set[str]) -> float:
        z = self.constant + sum(sorted(self.weights[f] for f in features))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on up to ``rows`` labelled rows; None where these hold only one label."""
    sample = stored(_sample(docs, labels, id_col, text_col, label_col, rows))
    names = _mined(sample, FEATURES)
    if not names:
        return None
    index = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [sorted(index.value[f] for f in text_features(t) if f in index.value) for t in pdf["t"]]
            yield pd.DataFrame({"y": pdf["y"], "f": got})

    held = sample.mapInPandas(known, "y int, f array<int>").toPandas()
    order = sorted(range(len(held)), key=lambda i: (held["y"][i], list(held["f"][i])))
    found, notes = [np.array(held["f"][i], dtype=np.int64) for i in order], held["y"].to_numpy()[order]
    votes = np.zeros((len(found), min(VOTERS, len(names))))
    for i, f in enumerate(found):
        votes[i, f[f < votes.shape[1]]] = 1
    q = LabelModel().fit(votes, notes).posterior(votes, notes)
    w, b = fit_linear(found, q, len(names))
    return Model(dict(zip(names, w.tolist())), b)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row of ``docs``; null texts count as empty; without a model all scores are 0."""
    if model is None:
        return docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value

        class Known(dict):
            def __missing__(self, word: str) -> tuple[str, ...]:
                if len(self) >= 300_000:
                    self.clear()
                self[word] = got = tuple(f for f in word_features(word) if f in model.weights)
                return got

        known = Known()
        for pdf in batches:
            out = [model.score(set().union(*map(known.__getitem__, set(_WORD.findall(t.lower()))))) if t else model.score(set()) for t in pdf["t"]]
            yield pd.DataFrame({"i": pdf["i"], "score": out})

    # ids travel as text: a null among integers would turn the whole batch into floats
    scored = docs.select(F.col(id_col).cast("long").cast("string").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, "i string, score double")
    return scored.select(F.col("i").cast("long").alias("id"), "score")


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``.

    Only labels of rows that are not held out are read; ids, languages and sources never enter a score. Null and empty
    texts get the score of a text without any known feature; repeated rows get a row each, null ids stay null.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxic_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")
