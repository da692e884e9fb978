"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Each labeller votes good (1), bad (-1) or abstains (0) on a whole text.  Votes of all documents are counted by pattern (at
most 3 ** 11 patterns, whatever the input), and EM on the pattern counts estimates how often each labeller votes what on
good and on bad documents; an abstention says nothing.  Posteriors of a bounded sample of documents (``SAMPLE`` by hash order) train a linear scorer
on hashed words and shape features, which then scores every whole text.

Defined results: a null text counts as empty; repeated rows score alike; if no labeller ever votes, every posterior is
the prior; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signaldesk.llm.common import fresh, small_batches, table

SAMPLE = 4_000
BUCKETS = 1 << 15
PRIOR = 0.8      # share of good documents that EM starts from
ROUNDS = 60
GOOD_VOTES, BAD_VOTES = np.array([0.03, 0.97]), np.array([0.35, 0.65])   # shares of bad and good votes
BELIEF = 0.03    # of the documents


def measures(text: Column) -> dict[str, Column]:
    """What the labellers look at, each taken once from the whole text."""
    t = F.coalesce(text, F.lit(""))
    words, lines, sentences = F.split(F.btrim(t), "\\s+"), F.split(t, "\n"), F.split(t, "[.!?\n]+\\s*")

    def count(pattern: str) -> Column:
        return F.size(F.split(t, pattern)) - 1

    return {
        "n": F.greatest(F.char_length(t), F.lit(1)), "n_words": F.size(words), "distinct": F.size(F.array_distinct(words)), "symbols": count("[#*$%&|<>]"), "marks": count("[!?]"),
        "stops": count("[.!?]"), "capitals": count("[A-Z]"), "odd": count("[^\\p{L}\\p{N}\\s]"), "marked": count("[#*$%&!?]{2,}(\\s|$)"),
        "n_lines": F.size(lines), "distinct_lines": F.size(F.array_distinct(lines)), "n_sentences": F.size(sentences), "distinct_sentences": F.size(F.array_distinct(sentences))}


def with_votes(docs: DataFrame, prefix: str = "vote_") -> DataFrame:
    """Every row with the votes of the heuristic labellers; several look at the same defects."""
    own = {k: fresh(docs.columns, f"_m_{k}") for k in measures(F.col("text"))}
    df = docs.select("*", *(c.alias(own[k]) for k, c in measures(F.col("text")).items()))
    m = {k: F.col(c) for k, c in own.items()}
    n, n_words = m["n"], m["n_words"]

    def vote(good: Column, bad: Column) -> Column:
        return F.when(n_words < 15, 0).when(bad, -1).when(good, 1).otherwise(0)

    votes = {
        "length": vote(n_words >= 50, n_words < 20),
        "symbols": vote(m["symbols"] < n * 0.002, m["symbols"] > n * 0.03),
        "shouting": vote(m["capitals"] < n * 0.06, m["capitals"] > n * 0.3),
        "marks": vote(m["marks"] < n_words * 0.05, m["marks"] > n_words * 0.3),
        "sentences": vote((m["stops"] > 1) & (n_words < m["stops"] * 40), n_words > (m["stops"] + 1) * 120),
        "odd_characters": vote(m["odd"] < n * 0.06, m["odd"] > n * 0.12),
        "marked_words": vote(m["marked"] < n_words * 0.02, m["marked"] > n_words * 0.2),
        "variety": vote(m["distinct"] > n_words * 0.45, (n_words >= 50) & (m["distinct"] < n_words * 0.3)),
        "repeated_sentences": vote(m["distinct_sentences"] > m["n_sentences"] * 0.9, m["distinct_sentences"] < m["n_sentences"] * 0.6),
        "repeated_lines": vote((m["n_lines"] > 1) & (m["distinct_lines"] > m["n_lines"] * 0.8), m["distinct_lines"] < m["n_lines"] * 0.5),
        "word_length": vote((n < n_words * 10) & (n > n_words * 4), (n > n_words * 14) | (n < n_words * 3)),
    }
    return df.select(*docs.columns, *(v.alias(prefix + k) for k, v in votes.items()))


VOTES = ("length", "symbols", "shouting", "marks", "sentences", "odd_characters", "marked_words", "variety", "repeated_sentences", "repeated_lines", "word_length")


def fit_votes(counts: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, float]:
    """Log odds of each (labeller, vote) and the share of good documents, by EM over pattern counts."""
    votes, n = counts[names].to_numpy(int) + 1, counts["n"].to_numpy(float)
    hit = np.stack([votes == 0, votes == 2], axis=2).astype(float)               # pattern, labeller, (bad, good)
    # Labellers are taken to be better than chance: so many documents of either class back that in every round.
    believed = BELIEF * n.sum() * np.stack([GOOD_VOTES, BAD_VOTES])
    good, bad = (np.tile(v, (len(names), 1)) for v in (GOOD_VOTES, BAD_VOTES))
    share, voted = PRIOR, hit.any(axis=(1, 2))
    for _ in range(ROUNDS):
        odds = math.log(share / (1 - share)) + (hit * (np.log(good) - np.log(bad))).sum(axis=(1, 2))
        post = np.where(voted, 1 / (1 + np.exp(-np.clip(odds, -50, 50))), 0)
        weights = post * n, (voted - post) * n
        good, bad = ((hit * w[:, None, None]).sum(axis=0) + b + 0.5 for w, b in zip(weights, believed))
        good, bad = good / good.sum(axis=1, keepdims=True), bad / bad.sum(axis=1, keepdims=True)
        share = min(0.99, max(0.01, (weights[0].sum() + 1) / (n[voted].sum() + 2)))
    log = np.log(good) - np.log(bad)
    return np.stack([log[:, 0], np.zeros(len(names)), log[:, 1]], axis=1), share


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words and word shapes with their weights."""
    words = (text or "").split()
    count: dict[int, int] = {}
    for w in words:
        k = zlib.crc32(w.encode()) % (BUCKETS - 64) + 64
        count[k] = count.get(k, 0) + 1
    n = max(1, len(words))
    chars = max(1, len(text or ""))
    t = text or ""
    shape = [sum(map(t.count, "#*$%&|<>")) / chars * 10, sum(map(t.count, "!?")) / n, sum(w.isupper() for w in words) / n, len(set(words)) / n,
             math.log1p(n) / 8, (t.count(".") + t.count("!") + t.count("?")) / n * 5, len(set(t.split("\n"))) / (t.count("\n") + 1), chars / n / 10, 1.0]
    at = np.array([*range(len(shape)), *count], np.int64)
    value = np.array(list(count.values()), np.float32)
    value = np.log1p(value)
    return at, np.concatenate([np.array(shape, np.float32) * 3, value / max(1e-6, float(np.linalg.norm(value)))])


def train_scorer(texts: list[str | None], target: np.ndarray, epochs: int = 8, rate: float = 0.3, seed: int = 5) -> np.ndarray:
    """Weights of a logistic scorer on soft targets, by adaptive gradient steps over batches of 32."""
    rows = [features(t) for t in texts]
    w, seen, rng = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 32):
            g = np.zeros(BUCKETS)
            for k in order[i:i + 32]:
                at, value = rows[k]
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ value)))))
                g[at] += (p - target[k]) * value / 32
            seen += g * g
            w -= rate * g / np.sqrt(seen)
    return w


def fit(docs: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, float]:
    names = [f"vote_{k}" for k in VOTES]
    seen = with_votes(docs.select("doc_id", "text"))
    counts = seen.groupBy(*names).agg(F.count("*").alias("n")).toPandas()  # at most 3 ** 11 rows
    odds, share = fit_votes(counts, names)
    picked = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    few = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id").limit(SAMPLE)
    sample = with_votes(few).select("text", *names).toPandas()
    if not len(sample):
        return odds, names, np.zeros(BUCKETS), share
    at = sample[names].to_numpy(int) + 1
    log = math.log(share / (1 - share)) + odds[np.arange(len(names)), at].sum(axis=1)
    return odds, names, train_scorer(list(sample["text"]), 1 / (1 + np.exp(-np.clip(log, -50, 50)))), share


def with_quality(docs: DataFrame, score: str = "score", posterior: str = "posterior") -> DataFrame:
    """Every row with its label posterior and the scorer's probability that it is good."""
    odds, names, weights, share = fit(docs)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in parts:
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ value))))) for at, value in map(features, texts)], dtype=float)

    probability.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    prefix = fresh([c[:6] for c in docs.columns], "_vote_")
    log = F.lit(math.log(share / (1 - share)))
    for k, name in enumerate(VOTES):
        log = log + F.element_at(F.array(*(F.lit(float(x)) for x in odds[k])), F.col(prefix + name) + 2)
    voted = with_votes(docs, prefix)
    return voted.select(*docs.columns, (1 / (1 + F.exp(-log))).alias(posterior), F.pandas_udf(probability, "double")(F.col("text")).alias(score))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
