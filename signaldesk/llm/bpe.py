"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

All new words of an Arrow batch lie in one flat symbol array.  A round looks up every neighbouring pair by binary search
over the sorted pair keys, takes each word's lowest rank and merges that pair wherever it stands in the word, from left
to right; words without a known pair leave the array.  Words already met are kept in a bounded dictionary.  A single
word of over ``LONG_WORD`` bytes would take as many rounds as it has merges and goes through a heap of pairs instead.

Defined results: a null text counts as empty; an empty text has no tokens and decodes to the empty text; the strings of
special tokens in a text become those tokens, as the tokenizers library does by default; repeated rows encode alike; an
empty table gives an empty table; other columns play no part; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from signaldesk.llm.common import small_batches, table

LONG_WORD = 400
CACHE_WORDS = 150_000
#: Fixed value: the word pattern of this kind of vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letter by which the vocabulary writes each byte: itself where visible, else the next letters from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Pair keys in order with rank and merged id, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * self.size
        for word, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.start = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.start[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.none = np.int32(len(pairs))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as little-endian 32-bit integers."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                ids = self._heap(w)
                done.append((np.full(len(ids), i), np.array(ids, np.int64)))
        sym = self.start[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        word = np.repeat(np.array(short, np.int64), [len(words[i]) for i in short])
        while len(sym):
            rank = self.ranks(sym[:-1], sym[1:])
            rank[word[:-1] != word[1:]] = self.none
            rank = np.append(rank, self.none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            least = np.repeat(least, np.diff(np.append(first, len(sym))))
            open_ = least < self.none
            hit = open_ & (rank == least)
            # In a run of hits (equal symbols) every other one merges, from the left.
            at = np.flatnonzero(hit)
            start = np.append(True, np.diff(at) > 1)
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not open_.all():
                done.append((word[~open_], sym[~open_]))
            sym[at] = self.merged[rank[at]]
            keep = open_
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return [b""] * len(words)
        word, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        flat = sym[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _heap(self, word: bytes) -> list[int]:
        sym = self.start[np.frombuffer(word, np.uint8)]
        ranks = self.ranks(sym[:-1], sym[1:])
        sym, n = sym.tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, sym[i], sym[i + 1]) for i, r in enumerate(ranks) if r < self.none]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            key = sym[i] * self.size + sym[j]
            at = int(np.searchsorted(self.keys, key))
            if at < len(self.keys) and self.keys[at] == key:
                heapq.heappush(heap, (int(self.rank[at]), i, sym[i], sym[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s in sym if s >= 0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> MergeTable:
    return MergeTable(path)


class Encoder:
    """Whole texts to ids, with a bounded dictionary of words already encoded."""

    def __init__(self, merges: MergeTable, most: int = CACHE_WORDS):
        self.merges, self.most, self.known = merges, most, {}
        self.words = regex.compile(WORDS)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.special = {w: int(i).to_bytes(4, "little") for w, i in merges.special.items()}

    def pieces(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.split.split(text):
            out.extend([part] if part in self.special else self.words.findall(part))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        if len(self.known) > self.most:
            self.known = {}
        self.known.update(self.special)
        new = list({w for words in split for w in words} - self.known.keys())
        for i in range(0, len(new), 50_000):
            part = new[i:i + 50_000]
            self.known.update(zip(part, self.merges.encode_words([w.encode() for w in part])))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def digests(path: str):
    def batches(parts):
        merges = load(path)
        encoder = Encoder(merges)
        for pdf in parts:
            ids = encoder.encode([t or "" for t in pdf["text"]])
            decoded = [merges.decode(np.frombuffer(b, "<u4")) for b in ids]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_tokens": [len(b) // 4 for b in ids], "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decoded]})

    return batches


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; ``path``: the vocabulary file, on every executor."""
    small_batches(docs.sparkSession, 500)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(digests(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of every document."""
    small_batches(docs.sparkSession, 500)
    kind = dict(docs.dtypes)["doc_id"]

    def batches(parts):
        encoder = Encoder(load(path))
        for pdf in parts:
            ids = encoder.encode([t or "" for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": pd.Series([np.frombuffer(b, "<u4").astype(np.int32) for b in ids], dtype=object, index=pdf.index)})

    return docs.select("doc_id", "text").mapInPandas(batches, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of every row of token ids (null ids: empty)."""
    small_batches(encoded.sparkSession, 500)
    kind = dict(encoded.dtypes)["doc_id"]

    def batches(parts):
        merges = load(path)
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [merges.decode(np.asarray([] if x is None else x, np.int64)) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(batches, f"doc_id {kind}, text string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path())
