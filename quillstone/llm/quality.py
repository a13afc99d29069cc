"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import row_key, stored
from quillstone.llm.rules import rule_ledger

#: Labelled documents (of smallest hash) that the document classifier is fitted on.
FITTED = 20_000
#: Score from which a document is kept.
KEEP = 0.5

_RATIO = "least({0} / greatest({1}, 1), 4.0D)"
#: Features of a document, from the rule ledger's measurements.
FEATURES = (
    _RATIO.format("n_symbols", "n_words"),
    _RATIO.format("n_marks", "n_words"),
    _RATIO.format("n_upper", "n_letters"),
    _RATIO.format("n_dup_lines", "n_lines"),
    _RATIO.format("n_repeat_words", "n_words"),
    _RATIO.format("n_distinct_words", "n_words"),
    "least(word_chars / greatest(n_words, 1), 20.0D)",
    "ln(1.0D + n_words)",
    _RATIO.format("n_lines", "n_words"),
    "double(n_words = 0)",
)


@dataclass
class Classifier:
    """Logistic regression: the evidence is log odds against the prior of the labelled documents."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def evidence(self) -> Column:
        total = F.lit(float(self.bias - np.log(self.prior / (1 - self.prior)) - (self.weights * self.mean / self.scale).sum()))
        for feature, w in zip(FEATURES, self.weights / self.scale, strict=True):
            total = total + F.lit(float(w)) * F.expr(feature)
        return F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))


def fit_classifier(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge-regularised maximum likelihood by Newton steps. Without both classes the evidence is 0 everywhere."""
    n, d = x.shape if x.size else (0, len(FEATURES))
    prior = (y.sum() + 1) / (n + 2)
    if n == 0 or y.min() == y.max():
        return Classifier(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(prior / (1 - prior))), prior)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(n)])
    w = np.zeros(d + 1)
    ridge = np.append(np.full(d, 1.0), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]), prior)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _shrunk(groups: DataFrame, parent: Column, good: str, n: str, strength: float) -> Column:
    """Posterior mean of a Beta prior with the parent's mean and so many documents' strength."""
    return (F.col(good) + strength * parent) / (F.col(n) + strength)


def _strength(sums) -> float:
    """Prior strength by the method of moments: sums over sites of n, good and the squared deviation from the mean."""
    if not sums or not sums.sites or not sums.between:
        return 1000.0
    mean = min(max(sums.mean, 1e-6), 1 - 1e-6)
    # between: variance of the sites' means beyond the sampling variance
    return float(min(max(mean * (1 - mean) / max(sums.between, 1e-9) - 1, 1.0), 1000.0))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of each row of docs (doc_id, text, source, lang; other columns are ignored).

    Returns doc_id, row_key (of doc_id and text), evidence (log odds of the document's own text), host and path (posterior
    shares of good documents of the source, and of its language section), score, kept (score >= KEEP).

    labels: doc_id, quality (1 good); null and repeated labels are settled by the larger value, rows without doc_id are
    left out. The classifier is fitted on FITTED labelled documents at most. A site's posterior counts every document of
    the corpus with its probability: it shrinks to its host's by a Beta prior, and the host's to the corpus's, with
    strengths by the method of moments, so that sparse sites follow the global prior. The score is the document's
    evidence with its path's posterior, itself left out, as prior, which is floored and capped at even odds of ten to one, so that clear
    evidence decides alone.

    Null and empty texts measure 0 and are scored by that. A null source or lang is a site of its own. Repeated rows get a
    row each. Without labels of both classes every evidence is 0 and all rows are kept. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", "source", "lang").withColumn("row_key", row_key("doc_id", "text"))
    ledger = stored(rule_ledger(docs, keep=("doc_id", "row_key", "source", "lang")), "quality")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FITTED)
    known = stored(known, "labelled")  # FITTED rows at most, fit to be broadcast
    rows = ledger.join(F.broadcast(known), "doc_id").select("doc_id", F.array(*[F.expr(f).cast("double") for f in FEATURES]).alias("x"), (F.col("quality") > 0).cast("double").alias("y"))
    # one row for each label, though ids may be repeated; in a fixed order
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("row"))
    sample = rows.select("doc_id", "row.x", "row.y").toPandas().sort_values("doc_id")
    model = fit_classifier(np.array(sample["x"].tolist()), sample["y"].to_numpy())

    scored = ledger.select("doc_id", "row_key", "source", "lang", model.evidence().alias("evidence"))
    prior = float(np.log(model.prior / (1 - model.prior)))
    good = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    paths = stored(scored.groupBy("source", "lang").agg(F.sum(good).alias("good"), F.count(F.lit(1)).cast("double").alias("n")), "paths")
    hosts = paths.groupBy("source").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))

    def moments(sites: DataFrame, good: str, n: str):
        share = F.col(good) / F.col(n)
        whole = sites.agg(F.count(F.lit(1)).alias("sites"), (F.sum(good) / F.sum(n)).alias("mean"), F.var_pop(share).alias("v"), F.avg(share * (1 - share) / F.col(n)).alias("s"))
        return whole.select("sites", "mean", F.greatest(F.col("v") - F.col("s"), F.lit(0.0)).alias("between")).first()

    top = moments(hosts, "host_good", "host_n")
    mean = F.lit(float(top.mean) if top.mean is not None else model.prior)
    host = _shrunk(hosts, mean, "host_good", "host_n", _strength(top))
    hosts = hosts.select(F.col("source").alias("host_source"), host.alias("host"))
    strength = _strength(moments(paths, "good", "n"))
    sites = paths.join(hosts, F.col("source").eqNullSafe(F.col("host_source"))).select("source", "lang", "host", "good", "n", _shrunk(paths, F.col("host"), "good", "n", strength).alias("path"))
    sites = stored(sites.select(F.col("source").alias("s"), F.col("lang").alias("l"), "host", "path", F.col("good").alias("site_good"), F.col("n").alias("site_n")), "sites")

    # a document's own evidence is not counted twice: its prior is its path's posterior without it
    others = (F.col("site_good") - good + strength * F.col("host")) / (F.col("site_n") - 1 + strength)
    bounded = F.least(F.greatest(_logit(F.least(F.greatest(others, F.lit(1e-9)), F.lit(1 - 1e-9))), F.lit(-2.3)), F.lit(2.3))
    score = 1 / (1 + F.exp(-(F.col("evidence") + bounded)))
    out = scored.join(sites, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")))
    out = out.select("doc_id", "row_key", "evidence", "host", "path", score.alias("score"))
    single = F.lit(bool(np.all(model.weights == 0)))
    return out.withColumn("kept", single | (F.col("score") >= KEEP))
