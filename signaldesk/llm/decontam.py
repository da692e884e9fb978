"""Benchmark decontamination by latent semantic retrieval, then longest-common-subsequence and answer checks.

Only terms of the benchmark carry weight.  Their document frequencies are counted over all documents; passages (windows
of words that overlap) with at least ``min_rare`` of the items' rarer terms become sparse TF-IDF rows.  A randomised SVD
of those rows (range finder with one power step, each product a distributed sum) gives the latent space.  Passages of
every document whose cosine to an item reaches ``cosine`` are aligned with it: the weighted longest common subsequence
within the densest stretch must cover ``verbatim`` of the item, or ``paraphrase`` if the item's answer (its last
sentence) is there as well.

The benchmark is the query set: it is taken in blocks of ``block`` items, each block in its own pass over the documents.

Defined results: null or empty texts and items without words match nothing; of items with equal ids each is searched;
repeated rows give one result row for each (doc_id, item_id); an empty table on either side gives an empty result; other
columns play no part; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from signaldesk.llm.common import small_batches, staged, table

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    window: int = 64
    stride: int = 32
    rank: int = 192
    oversample: int = 16
    rarest: int = 8           # terms of an item that count as rare, whatever their frequency
    common: float = 0.001     # share of documents up to which any term counts as rare
    min_rare: int = 3
    cosine: float = 0.4
    verbatim: float = 0.7
    paraphrase: float = 0.5
    answer: float = 0.6       # of the answer's weight
    block: int = 20_000
    seed: int = 3


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of a-z, 0-9 and bytes above 127, A-Z lower-cased."""
    return (text or b"").translate(_KEEP).split()


def answer_words(text: bytes | None) -> list[bytes]:
    """Words of the last sentence."""
    parts = [w for w in map(words_of, re.split(rb"[.!?\n]+", text or b"")) if w]
    return parts[-1] if parts else []


class Items:
    """One block of the benchmark: vocabulary, term numbers of each item and of its answer, and weights once known."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]):
        self.vocab: dict[bytes, int] = {}
        self.ids, self.terms, self.answers = [], [], []
        for item, text in rows:
            words = words_of(text)
            if words:
                self.ids.append(item)
                self.terms.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words]))
                self.answers.append(np.array([self.vocab[w] for w in answer_words(text)]))
        self.idf = self.rare = self.basis = self.latent = None

    def weigh(self, df: np.ndarray, n: int, s: Settings) -> None:
        self.idf = np.append(np.log((n + 1) / (df + 1)) + 0.05, 0).astype(np.float32)  # the last entry: not a term
        self.rare = np.append(df <= s.common * n, False)
        for t in self.terms:
            own = np.unique(t)
            self.rare[own[np.argsort(df[own], kind="stable")[:s.rarest]]] = True
        # A short item has few terms: half of them must do.
        self.least = max(1, min(s.min_rare, min(len(np.unique(t)) for t in self.terms) // 2))

    def project(self, basis: np.ndarray) -> None:
        self.basis = np.vstack([basis, np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32) * self.idf[:, None]
        latent = np.stack([self.basis[t].sum(axis=0) for t in self.terms])
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def numbers(self, text: bytes | None) -> np.ndarray:
        get, none = self.vocab.get, len(self.vocab)
        return np.array([get(w, none) for w in words_of(text)], np.int64)

    def windows(self, numbers: np.ndarray, s: Settings) -> np.ndarray:
        """Starts of the windows that hold enough rare terms."""
        held = np.concatenate([[0], np.cumsum(self.rare[numbers])])
        if held[-1] < self.least:
            return np.empty(0, np.int64)
        starts = np.arange(0, max(1, len(numbers) - s.window + s.stride), s.stride)
        return starts[held[np.minimum(starts + s.window, len(numbers))] - held[starts] >= self.least]

    def search(self, numbers: np.ndarray, s: Settings) -> list[tuple]:
        """(item, cosine, lcs, answer, first word) of the item's best passage, for every item found."""
        best: dict[int, tuple] = {}
        starts = self.windows(numbers, s)
        if not len(starts):
            return []
        latent = np.stack([self.basis[numbers[a:a + s.window]].sum(axis=0) for a in starts])
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        cos = (latent / np.maximum(norm, 1e-9)) @ self.latent.T
        for w, item in zip(*np.nonzero(cos >= s.cosine)):
            near = np.zeros(len(self.idf), bool)
            near[numbers[max(0, starts[w] - len(self.terms[item])):starts[w] + s.window + len(self.terms[item])]] = True
            terms = self.terms[item]
            if self.idf[terms][near[terms]].sum() < s.paraphrase * self.idf[terms].sum():
                continue  # no order of these words could cover enough
            at, lcs, answer = self.align(numbers, int(starts[w]), item, s)
            if (lcs >= s.verbatim or lcs >= s.paraphrase and answer >= s.answer) and (item not in best or lcs > best[item][2]):
                best[item] = (self.ids[item], float(cos[w, item]), float(lcs), bool(answer >= s.answer), at)
        return list(best.values())

    def align(self, numbers: np.ndarray, start: int, item: int, s: Settings) -> tuple[int, float, float]:
        """First word, covered share of the item's weight and of its answer's, in the densest stretch near a window."""
        terms = self.terms[item]
        low, high = max(0, start - len(terms)), min(len(numbers), start + s.window + len(terms))
        own = np.zeros(len(self.idf), np.float32)
        own[terms] = self.idf[terms]
        sums = np.concatenate([[0], np.cumsum(own[numbers[low:high]], dtype=np.float64)])
        span = min(len(sums) - 1, len(terms) + len(terms) // 4 + 4)
        at = low + int(np.argmax(sums[span:] - sums[:len(sums) - span]))
        part = numbers[at:at + span]
        row = np.zeros(span + 1)
        for t in terms:
            row[1:] = np.maximum(row[1:], row[:-1] + np.where(part == t, self.idf[t], 0))
            row = np.maximum.accumulate(row)
        answer = self.answers[item]
        found = np.isin(answer, part)
        return at, row[-1] / max(self.idf[terms].sum(), 1e-9), self.idf[answer][found].sum() / max(self.idf[answer].sum(), 1e-9)


def blocks_of(benchmark: DataFrame, s: Settings) -> Iterator[Items]:
    """The query set in bounded blocks, in the order of a written numbering."""
    numbered = staged(benchmark.select("item_id", F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 20)).alias("part")), "items")
    n = numbered.count()
    blocks = max(1, -(-n // s.block))
    for b in range(blocks):
        rows = numbered.where(F.col("part") % blocks == b).select("item_id", "text").collect()
        items = Items([(r["item_id"], bytes(r["text"]) if r["text"] is not None else None) for r in rows])
        if items.ids:
            yield items


def frequencies(texts: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and the number of documents; what is collected is bounded by the block's terms."""
    size = len(items.vocab)

    def count(parts):
        df, n = np.zeros(size + 1, np.int64), 0
        for pdf in parts:
            n += len(pdf)
            for t in pdf["text"]:
                df[np.unique(items.numbers(t))] += 1
        df[size] = n
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": some, "n": df[some]})

    rows = texts.mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size + 1, np.int64)
    df[rows["term"].to_numpy()] = rows["n"]
    return df[:size], int(df[size])


def latent_basis(texts: DataFrame, items: Items, s: Settings) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF rows (terms x rank), by a randomised range finder."""
    size, width = len(items.vocab), min(s.rank + s.oversample, len(items.vocab))

    def cut(parts):
        for pdf in parts:
            rows = []
            for t in pdf["text"]:
                numbers = items.numbers(t)
                for a in items.windows(numbers, s):
                    part = numbers[a:a + s.window]
                    rows.append(part[part < size].astype(np.int32))
            yield pd.DataFrame({"terms": pd.Series(rows, dtype=object)})

    passages = staged(texts.mapInPandas(cut, "terms array<int>"), "passages")
    idf = items.idf[:-1, None]

    def product(test: np.ndarray) -> np.ndarray:
        """A'A x test; each task sends its sum in blocks of terms, which are added up before they reach the driver."""
        weighted, step = (test * idf).astype(np.float32), 512

        def gram(total: np.ndarray, rows: list[np.ndarray]) -> None:
            """Adds a'(a x test) of sparse rows a, given as term numbers."""
            rows = [t for t in rows if len(t)]
            for k in range(0, len(rows), 500):
                part = rows[k:k + 500]
                flat, size_of = np.concatenate(part), np.array([len(t) for t in part])
                image = np.add.reduceat(weighted[flat], np.concatenate([[0], np.cumsum(size_of)[:-1]]), axis=0)
                order = np.argsort(flat, kind="stable")
                own, first = np.unique(flat[order], return_index=True)
                total[own] += np.add.reduceat(image[np.repeat(np.arange(len(part)), size_of)[order]], first, axis=0)

        def add(parts):
            total = np.zeros((size, test.shape[1]), np.float32)
            for pdf in parts:
                gram(total, list(pdf["terms"]))
            for b in range(0, size, step):
                yield pd.DataFrame({"block": [b], "sums": [total[b:b + step].ravel().astype(float)]})

        def merge(pdf):
            return pd.DataFrame({"block": pdf["block"][:1], "sums": [np.sum(np.stack(pdf["sums"]), axis=0)]})

        total = np.zeros((size, test.shape[1]))
        gram(total, items.terms)
        added = passages.mapInPandas(add, "block long, sums array<double>").groupBy("block").applyInPandas(merge, "block long, sums array<double>")
        for r in added.collect():
            total[r["block"]:r["block"] + step] += np.array(r["sums"]).reshape(-1, test.shape[1])
        return total * idf

    q = np.linalg.qr(np.random.default_rng(s.seed).standard_normal((size, width)))[0]
    q = np.linalg.qr(product(q))[0]
    small = product(q)
    _, vectors = np.linalg.eigh(q.T @ small)
    return (q @ vectors[:, ::-1][:, :s.rank]).astype(np.float32)


FOUND = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.DoubleType()),
                                  T.StructField("answer_found", T.BooleanType()), T.StructField("first_word", T.LongType())]))


def prepared(docs: DataFrame, benchmark: DataFrame, s: Settings) -> Iterator[Items]:
    """Each block of items with weights and latent vectors."""
    small_batches(docs.sparkSession, 500)
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    for items in blocks_of(benchmark, s):
        df, n = frequencies(texts, items)
        if n:
            items.weigh(df, n, s)
            items.project(latent_basis(texts, items, s))
            yield items


def finder(items: Items, s: Settings):
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([[dict(zip(("item", "cosine", "lcs", "answer_found", "first_word"), x)) for x in items.search(items.numbers(t), s)] for t in texts], dtype=object)

    found.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(found, FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each document and item whose passage it holds."""
    out = None
    for items in prepared(docs, benchmark, s):
        hits = docs.select("doc_id", F.explode(finder(items, s)(F.col("text").cast("binary"))).alias("hit"))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id long, cosine double, lcs double, answer_found boolean, first_word long")
    best = out.groupBy("doc_id", F.col("hit.item").alias("item_id")).agg(F.max(F.struct("hit.lcs", "hit.cosine", "hit.answer_found", "hit.first_word")).alias("best"))
    return best.select("doc_id", "item_id", "best.cosine", "best.lcs", "best.answer_found", "best.first_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Documents without a benchmark passage."""
    out = docs
    for items in prepared(docs, benchmark, s):
        out = out.where(F.size(finder(items, s)(F.col("text").cast("binary"))) == 0)
    return out


def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
