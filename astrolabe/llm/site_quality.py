"""Quality by hierarchical empirical Bayes.

A logistic classifier of a document's own counts gives its evidence. The mean evidence of a host (`source`), and of a
path on it (`lang`, the first step of the site's paths), are beta-binomial posteriors: a path is shrunk toward its
host, a host toward the global mean, with prior strengths estimated from how much paths and hosts differ beyond chance
(method of moments). A document's score joins its own evidence with its path's posterior, from which the document
itself is left out.

The classifier is fitted on at most FIT_ROWS labelled rows, chosen by a hash of the id (a parameter), whose
crc32(doc_id) modulo 5 is not 0; the sites' posteriors cover all documents.

Defined results: null and empty texts count as texts without words; a null host or path is a group of its own; without
good or without bad labels the evidence is nil and the score is (good + 0.5) / (labelled + 1); of several labels of one
id the worse one counts; repeated rows count each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import logistic, map_rows, remainder, staged, text_or_empty
from .quality_rules import base_counts

FIT_ROWS = 20_000
WEAKEST, STRONGEST = 2.0, 1e6


def features(texts: list[str]) -> list[list[float]]:
    c = base_counts(texts)
    out = []
    for k, t in enumerate(texts):
        words, chars = c["n_words"][k], max(1, c["word_chars"][k])
        some = max(1, words)
        lines = t.count("\n") + 1
        capital = sum(map(str.isupper, t))
        out.append([
            math.log1p(words), math.sqrt(c["n_symbols"][k] / chars), c["n_repeat_words"][k] / some, c["n_dup_lines"][k] / lines,
            min(20.0, chars / some), min(1.0, capital / chars), float(words < 50), (t.count("!") + t.count("|")) / some,
        ])
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[float], list[float], list[float], float]:
    """Means, scales, weights and bias of the document classifier."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(remainder("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # fit_rows ids at most

    def make():
        return lambda b: {"quality": b["quality"], "x": features(b["text"])}

    got = sorted((r.quality, list(r.x)) for r in map_rows(rows.select("text", "quality"), "quality int, x array<double>", make).collect())
    y = np.array([q for q, _ in got], float)
    n = 8
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return [0.0] * n, [1.0] * n, [0.0] * n, math.log(share / (1 - share))
    x = np.array([v for _, v in got])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w, bias = logistic((x - mean) / scale, y)
    return mean.tolist(), scale.tolist(), w.tolist(), bias


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: str, toward: str, within: float) -> float:
    """How many documents a prior is worth: the variance in a document over that between groups, by moments."""
    r = groups.agg(
        F.sum(F.col("n") * F.pow(F.col(rate) - F.col(toward), 2)).alias("between"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")
    ).first()
    if not r.n or r.k < 2:
        return STRONGEST
    excess = (r.between - within * r.k) / r.n
    return STRONGEST if excess <= 0 else min(STRONGEST, max(WEAKEST, within / excess))


def judge(docs: DataFrame, model: tuple[list[float], list[float], list[float], float]) -> DataFrame:
    """One row per document: doc_id, held_out, evidence, host_rate, path_rate, score, kept."""
    mean, scale, weights, bias = model

    def make():
        m, s, w = np.array(mean), np.array(scale), np.array(weights)

        def work(b: dict[str, list]) -> dict[str, list]:
            x = np.array(features(b["text"])).reshape(len(b["text"]), len(m))
            z = np.clip(((x - m) / s) @ w, -15, 15)
            return {k: b[k] for k in ("doc_id", "held_out", "host", "path")} | {"z": z.tolist()}

        return work

    rows = docs.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"),
        F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"), text_or_empty().alias("text"),
    )
    seen = staged(map_rows(rows, "doc_id long, held_out boolean, host string, path string, z double", make).withColumn("p", 1 / (1 + F.exp(-(F.col("z") + F.lit(bias))))), "site-evidence")
    # one row a path: a sum and a count of each, combined within tasks first
    paths = staged(seen.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * F.col("p")).alias("q")), "site-paths")
    s, n, q = paths.agg(F.sum("s"), F.sum("n"), F.sum("q")).first()
    prior = (s + 0.5) / (n + 1) if n else 0.5
    within = max(1e-6, (q / n - (s / n) ** 2) if n else 1.0)
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("rate", F.col("s") / F.col("n")).withColumn("prior", F.lit(prior))
    host_strength = _strength(hosts, "rate", "prior", within)
    hosts = hosts.select("host", ((F.col("s") + host_strength * prior) / (F.col("n") + host_strength)).alias("host_rate"))
    sites = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host).withColumn("rate", F.col("s") / F.col("n"))
    path_strength = _strength(sites, "rate", "host_rate", within)
    sites = staged(sites.select("host", "path", "s", "n", "host_rate"), "site-posteriors")
    named = seen.join(sites, seen.host.eqNullSafe(sites.host) & seen.path.eqNullSafe(sites.path), "left").drop(sites.host).drop(sites.path)
    rate = (F.col("s") - F.col("p") + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength)
    rate = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    out = named.select("doc_id", "held_out", F.col("z").alias("evidence"), "host_rate", rate.alias("path_rate"), _logit(F.lit(prior)).alias("base"), F.lit(bias).alias("bias"))
    # the classifier's own bias holds the global rate; the path's posterior takes its place
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.col("bias") - F.col("base") + _logit(F.col("path_rate")))))
    return out.select("doc_id", "held_out", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= 0.5).alias("kept"))
