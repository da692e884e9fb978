"""Toxicity from a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Every blank-separated token enters as a word embedding and the mean of its character-gram embeddings (hashed tables, so
there is no vocabulary to ship).  A forward and a backward GRU read windows of ``window`` tokens that overlap; attention
pools their states; a document's score is that of its most toxic window.  Training is multiple-instance: of a toxic
document only the window that scores highest counts as toxic.

Training reads a bounded sample of labelled documents (``Settings.per_class`` ids of either class by hash order, those of
at most ``Settings.most_windows`` windows), never rows that are held out.  Scoring reads every window of every text.

Defined results: a null or empty text has one empty window and its score; repeated rows score alike; without labels of
both classes every score is the share of toxic labels (0 if there are none); an empty table gives an empty table; other
columns play no part.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signaldesk.llm.common import fresh, keep_where, small_batches, staged, table


@dataclass(frozen=True)
class Settings:
    window: int = 64
    stride: int = 48
    hidden: int = 8
    embed: int = 12
    attention: int = 8
    buckets: int = 1 << 14
    per_class: tuple[int, int] = (2500, 1500)   # clean, toxic ids drawn for training
    most_windows: int = 24                       # of a training document
    batch: int = 192
    epochs: int = 4
    rate: float = 0.01
    hidden_words: float = 0.4                    # share of words known by their characters alone, anew in each step
    seed: int = 7


SLICE = 512   # windows read at once when all are scored
_JUNK = re.compile(r"[^\w\n]|_")
GRAMS = (3, 5)


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows_of(n: int, s: Settings) -> list[tuple[int, int]]:
    """Overlapping spans that cover n tokens; one (empty) span for none."""
    last = max(0, n - s.window)
    starts = list(range(0, last, s.stride)) + [last]
    return [(i, min(n, i + s.window)) for i in starts]


class Features:
    """Hashed word and character-gram places of tokens, made for many tokens at once."""

    def __init__(self, s: Settings):
        self.s = s

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word bucket per token (0: no letter), gram buckets, and the token each gram belongs to."""
        joined = _JUNK.sub("", "\n" + "\n".join(t.replace("\n", "") for t in tokens) + "\n")
        cores = joined[1:-1].split("\n")
        mask = self.s.buckets - 1
        words = np.array([0 if not c else 1 + zlib.crc32(c.encode()) % mask for c in cores], np.int64)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        line = code == 10
        owner = np.cumsum(line) - 1
        all_grams, all_owners = [], []
        for n in GRAMS:
            m = len(code) - n + 1
            if m <= 0:
                continue
            inner = np.zeros(m, bool)
            h = np.full(m, 1469598103 + n, np.uint64)
            for k in range(n):
                part = code[k:k + m]
                h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < k < n - 1:
                    inner |= line[k:k + m]
            ok = ~inner & ~(line[:m] & line[n - 1:n - 1 + m])
            ok |= ~inner & line[:m] & line[n - 1:n - 1 + m]  # a whole short word between its ends
            all_grams.append((h[ok] >> np.uint64(20)).astype(np.int64) & mask)
            all_owners.append(owner[:m][ok])
        grams, owners = np.concatenate(all_grams), np.concatenate(all_owners)
        order = np.argsort(owners, kind="stable")
        # A gram that starts with the blank before a token carries the number of that blank, which is the token's own.
        return words, grams[order], owners[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, s: Settings):
        self.s = s
        rng = np.random.default_rng(s.seed)
        h, d = s.hidden, 2 * s.embed

        def init(*shape, scale=None):
            return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        self.p = {"word": init(s.buckets, s.embed, scale=0.1), "char": init(s.buckets, s.embed, scale=0.3),
                  "att": init(2 * h, s.attention), "att_v": init(s.attention, 1), "out": init(2 * h, 1), "bias": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        for side in "fb":
            self.p |= {f"w{side}": init(d, 3 * h), f"u{side}": init(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: np.ndarray, grams: np.ndarray, owners: np.ndarray) -> np.ndarray:
        n = len(words)
        count = np.maximum(np.bincount(owners, minlength=n), 1).astype(np.float32)
        total = np.zeros((n, self.s.embed), np.float32)
        if len(owners):
            first = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            total[owners[first]] = np.add.reduceat(self.p["char"][grams], first, axis=0)
        return np.concatenate([self.p["word"][words], total / count[:, None]], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions, (n, 6 x hidden)."""
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1)

    def _read(self, gates: np.ndarray, pad: np.ndarray, side: str, keep: bool):
        """States of one direction over (steps, rows, 3 x hidden); padded steps leave the state as it is."""
        steps, rows, h = gates.shape[0], gates.shape[1], self.s.hidden
        u, state = self.p[f"u{side}"], np.zeros((rows, self.s.hidden), np.float32)
        states = np.empty((steps, rows, h), np.float32)
        memo = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a, b = gates[t], state @ u
            zr = sigmoid(a[:, :2 * h] + b[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            z = np.where(pad[t][:, None], np.float32(1), z)
            n = np.tanh(a[:, 2 * h:] + r * b[:, 2 * h:])
            new = n + z * (state - n)
            if keep:
                memo.append((t, state, z, r, n, b[:, 2 * h:]))
            state = states[t] = new
        return states, memo

    def forward(self, projected: np.ndarray, index: np.ndarray, pad: np.ndarray, keep: bool = False):
        """Logit of each window; index, pad: (steps, rows)."""
        h3 = 3 * self.s.hidden
        gates = projected[index]
        f, mf = self._read(gates[..., :h3], pad, "f", keep)
        b, mb = self._read(gates[..., h3:], pad, "b", keep)
        states = np.concatenate([f, b], axis=2)
        hid = np.tanh(states @ self.p["att"])
        e = (hid @ self.p["att_v"])[..., 0]
        e = np.where(pad, np.float32(-30), e)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[..., None] * states).sum(axis=0)
        logit = (pooled @ self.p["out"])[:, 0] + self.p["bias"]
        return logit, (states, hid, a, pooled, mf, mb) if keep else None

    def gradients(self, x: np.ndarray, index: np.ndarray, pad: np.ndarray, memo, dlogit: np.ndarray):
        """Gradients of the dense parameters and of the token inputs x."""
        states, hid, a, pooled, mf, mb = memo
        h, p = self.s.hidden, self.p
        g = {"out": pooled.T @ dlogit[:, None], "bias": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * p["out"][:, 0]
        ds = a[..., None] * dpool
        da = (states * dpool).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        de[pad] = 0
        g["att_v"] = np.einsum("tba,tb->a", hid, de)[:, None]
        dh = de[..., None] * p["att_v"][:, 0] * (1 - hid ** 2)
        g["att"] = np.einsum("tbs,tba->sa", states, dh)
        ds += dh @ p["att"].T
        dx = np.zeros_like(x)
        for side, steps, part in (("f", mf, ds[..., :h]), ("b", mb, ds[..., h:])):
            u, du = p[f"u{side}"], np.zeros_like(p[f"u{side}"])
            back, dgate = np.zeros_like(part[0]), np.zeros((*index.shape, 3 * h), np.float32)
            for t, state, z, r, n, un in reversed(steps):
                d = back + part[t]
                dz, dn = d * (state - n) * z * (1 - z), d * (1 - z) * (1 - n ** 2)
                dz[pad[t]] = 0
                dr = dn * un * r * (1 - r)
                dgate[t] = np.concatenate([dz, dr, dn], axis=1)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                du += state.T @ db
                back = d * z + db @ u.T
            g[f"u{side}"] = du
            flat = np.zeros((len(x), 3 * h), np.float32)
            order = np.argsort(index.ravel(), kind="stable")
            own = index.ravel()[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            flat[own[first]] = np.add.reduceat(dgate.reshape(-1, 3 * h)[order], first, axis=0)
            g[f"w{side}"], g[f"c{side}"] = x.T @ flat, flat.sum(axis=0)
            dx += flat @ p[f"w{side}"].T
        return g, dx

    def spread(self, g: dict, dx: np.ndarray, words, grams, owners) -> dict:
        """Adds the gradients of the embedding tables."""
        e = self.s.embed
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], words, dx[:, :e])
        g["word"][0] = 0
        count = np.maximum(np.bincount(owners, minlength=len(words)), 1).astype(np.float32)
        np.add.at(g["char"], grams, (dx[:, e:] / count[:, None])[owners])
        return g


@dataclass
class Sample:
    """Training windows as numbers: places of their tokens among the vocabulary's, and the vocabulary's features."""

    index: np.ndarray    # (steps, windows); 0: no token
    pad: np.ndarray
    groups: np.ndarray   # the document of each window, from 0 on, in order
    toxic: np.ndarray    # the label of each document
    words: np.ndarray
    grams: np.ndarray
    owners: np.ndarray


def train(sample: Sample, s: Settings = Settings()) -> Network:
    net, rng = Network(s), np.random.default_rng(s.seed)
    index, pad, groups, toxic = sample.index, sample.pad, sample.groups, sample.toxic
    words, grams, owners = sample.words, sample.grams, sample.owners
    starts = np.flatnonzero(np.append(True, np.diff(groups) != 0))
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    gram_at = np.searchsorted(owners, np.arange(len(words) + 1))

    def logits() -> np.ndarray:
        out = np.empty(len(groups), np.float32)
        for i in range(0, len(groups), SLICE):
            ids, local = np.unique(index[:, i:i + SLICE], return_inverse=True)
            out[i:i + SLICE] = net.forward(net.project(net.inputs(*chosen(ids))), local.reshape(s.window, -1), pad[:, i:i + SLICE])[0]
        return out

    def chosen(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of some tokens of the vocabulary."""
        n = gram_at[ids + 1] - gram_at[ids]
        return words[ids], grams[np.repeat(gram_at[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(ids)), n)

    step = 0
    for epoch in range(s.epochs):
        if epoch:
            scores = logits()
            top = np.array([a + np.argmax(scores[a:b]) for a, b in zip(starts, np.append(starts[1:], len(groups)))])
            clean = np.flatnonzero(toxic[groups] == 0)
            hard = clean[np.argsort(-scores[clean])[:2 * len(starts)]]
            take = np.concatenate([top, hard, rng.choice(clean, min(len(clean), len(starts)), replace=False)])
        else:
            take = np.concatenate([starts + rng.integers(0, np.diff(np.append(starts, len(groups)))) for _ in range(4)])
        take = rng.permutation(take)
        for i in range(0, len(take), s.batch):
            cols = take[i:i + s.batch]
            ids, local = np.unique(index[:, cols], return_inverse=True)
            local, blank = local.reshape(s.window, -1), pad[:, cols]
            known, mine, own = chosen(ids)
            seen = np.where(rng.random(len(ids)) < s.hidden_words, 0, known)
            x = net.inputs(seen, mine, own)
            y = toxic[groups[cols]].astype(np.float32)
            logit, memo = net.forward(net.project(x), local, blank, keep=True)
            g, dx = net.gradients(x, local, blank, memo, ((sigmoid(logit) - y) / len(cols)).astype(np.float32))
            net.spread(g, dx, seen, mine, own)
            step += 1
            for k, v in net.p.items():
                m1, m2 = state[k]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.01 * (g[k] ** 2 - m2)
                v -= (s.rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores whole texts; gate inputs of tokens already met are kept in a bounded table."""

    def __init__(self, net: Network, most: int = 120_000, rows: int = 2048):
        self.net, self.most, self.rows, self.features = net, most, rows, Features(net.s)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.table = np.zeros((1, 6 * self.net.s.hidden), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        s = self.net.s
        split = [tokens_of(t) for t in texts]
        if len(self.known) > self.most:
            self.reset()
        new = list({t for words in split for t in words} - self.known.keys())
        if new:
            made = [self.net.project(self.net.inputs(*self.features.of(new[i:i + 20_000]))) for i in range(0, len(new), 20_000)]
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, *made])
        get = self.known.__getitem__
        flat = np.array([get(t) for words in split for t in words] + [0], np.int64)
        at, spans, owner = 0, [], []
        for k, words in enumerate(split):
            for a, b in windows_of(len(words), s):
                spans.append((at + a, b - a))
                owner.append(k)
            at += len(words)
        spans = np.array(spans, np.int64).reshape(-1, 2)
        order = np.argsort(spans[:, 1], kind="stable")  # windows of like length together
        logit = np.empty(len(spans), np.float32)
        for i in range(0, len(spans), self.rows):
            some = order[i:i + self.rows]
            steps = np.arange(max(1, int(spans[some, 1].max())))[:, None]
            pad = steps >= spans[some, 1]
            index = flat[np.where(pad, len(flat) - 1, np.minimum(spans[some, 0] + steps, len(flat) - 1))]
            logit[some] = self.net.forward(self.table, index, pad)[0]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, np.array(owner, np.int64), logit)
        return sigmoid(best).astype(float)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_of(windows, vocabulary, s: Settings) -> Sample:
    """windows: doc_id, toxic, at, keys; vocabulary: key, word, grams; both Arrow tables."""
    key = vocabulary["key"].to_numpy()
    key, first = np.unique(key, return_index=True)
    held = vocabulary["grams"].combine_chunks().take(first)
    length = np.diff(held.offsets.to_numpy())
    order = np.lexsort((windows["at"].to_numpy(), windows["doc_id"].to_numpy()))
    parts = windows["keys"].combine_chunks().take(order)
    ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    flat = 1 + np.searchsorted(key, parts.flatten().to_numpy())
    steps = np.arange(s.window)[:, None]
    size = np.diff(ends)
    pad = steps >= size
    index = np.zeros(pad.shape, np.int32)
    index.T[~pad.T] = flat
    groups, ids = pd.factorize(windows["doc_id"].to_numpy()[order])
    toxic = np.zeros(len(ids), np.int64)
    np.maximum.at(toxic, groups, windows["toxic"].to_numpy()[order])
    # Token 0 stands for none: no word, no grams.
    return Sample(index, pad, groups, toxic, np.append(0, vocabulary["word"].to_numpy()[first]), held.flatten().to_numpy().astype(np.int32), np.repeat(np.arange(1, len(key) + 1), length))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[Network | None, float]:
    """The network, or None and the share of toxic labels.

    Workers cut the windows and number their tokens; the driver gets numbers alone, of at most ``per_class`` documents of
    ``most_windows`` windows each, one text an id (of several, the first in order).
    """
    small_batches(docs.sparkSession, 500)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    ids = None
    for value, most in enumerate(s.per_class):
        part = usable.where(F.col("toxic") == value).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    few = sum(s.per_class)

    def cut(parts):
        for pdf in parts:
            rows = []
            for doc, text, toxic in zip(pdf["doc_id"], pdf["text"], pdf["toxic"]):
                words = tokens_of(text)
                spans = windows_of(len(words), s)
                if len(spans) <= s.most_windows:
                    rows += [(doc, int(toxic), at, words[a:b]) for at, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "at", "tokens"])

    def features(parts):
        made = Features(s)
        for pdf in parts:
            word, grams, owners = made.of(list(pdf["token"]))
            ends = np.searchsorted(owners, np.arange(len(pdf) + 1)).tolist()
            yield pd.DataFrame({"key": pdf["key"], "word": word, "grams": pd.Series([grams[a:b] for a, b in zip(ends, ends[1:])], index=pdf.index, dtype=object)})

    # The ids are at most few rows, whatever the input; both labels of an id count as toxic.
    known = docs.select("doc_id", "text").join(F.broadcast(ids.limit(few)), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    windows = staged(known.mapInPandas(cut, "doc_id long, toxic int, at int, tokens array<string>"), "windows")
    if windows.select("toxic").distinct().count() < 2:
        share = usable.agg(F.avg("toxic")).first()[0]
        return None, float(share or 0)
    tokens = windows.select(F.explode("tokens").alias("token")).distinct().select(F.xxhash64("token").alias("key"), "token")
    vocabulary = tokens.mapInPandas(features, "key long, word int, grams array<int>").toArrow()
    numbered = windows.select("doc_id", "toxic", "at", F.transform("tokens", lambda t: F.xxhash64(t)).alias("keys")).toArrow()
    sample = sample_of(numbered, vocabulary, s)
    del vocabulary, numbered
    return train(sample, s), 0.0


def with_score(docs: DataFrame, net: Network | None, prior: float, name: str = "score") -> DataFrame:
    """Every row with the score of its whole text; all columns stay."""
    if net is None:
        return docs.withColumn(name, F.lit(prior))
    small_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(net.p)
    settings = net.s

    def score(parts):
        own = Network(settings)
        own.p = shared.value
        scorer = Scorer(own)
        for texts in parts:
            out = np.empty(len(texts))
            for i in range(0, len(texts), 100):
                out[i:i + 100] = scorer.score(list(texts[i:i + 100]))
            yield pd.Series(out)

    return docs.withColumn(name, F.pandas_udf(score_type(score), "double")(F.col("text")))


def score_type(fn):
    """Typed the way pandas_udf wants it: an iterator of series."""
    from collections.abc import Iterator

    fn.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return fn


def drop_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """Documents that score below the threshold."""
    name = fresh(docs.columns, "toxicity")
    scored = with_score(docs, *fit(docs, labels, s), name)
    return keep_where(scored, F.col(name) < threshold).select(*docs.columns)


def toxicity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = with_score(docs, *fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
