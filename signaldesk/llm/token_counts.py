"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A text is a sequence of symbols (its characters).  The pair of neighbours with the lowest rank is popped from a heap and
merged, again and again; the list of neighbours is linked, so a merge touches two links.  The count is the number of
initial symbols less the merges; a character that the vocabulary lacks counts as its bytes until it is merged.

No entry of the vocabulary has a blank mark behind another letter (checked when it is read), so merges never cross from
a letter to a blank, and a text is cut there into words; the counts of short words are kept in a bounded dictionary.  A
text without blanks is one word and takes n log n steps.

Defined results: a null text counts as empty and has no tokens; a null id stays; repeated rows count alike; an empty
table gives an empty table; other columns play no part; texts are read whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from signaldesk.llm.common import small_batches, table

MARK = "▁"          # how the vocabulary writes a space
CACHE_WORDS = 400_000
CACHE_LETTERS = 64       # longer words are not kept
LIMIT = 4_096
PROBE = " a  b\té ﬁ Ａ\n"


class Ranks:
    """Rank of every entry that merges may make; lower ranks merge first, equal ones from the left."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError(f"{path} rewrites texts; only vocabularies over the text as it is are counted")
        ids = range(model.get_piece_size())
        self.bytes = any(model.is_byte(i) for i in ids)
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        long = [p for p in self.rank if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            raise ValueError(f"{path} has entries that cross from a letter to a blank")
        joined = set("".join(long))
        # Characters that never merge stand alone; no merge crosses from a letter to one of the closers.
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined)
        before = {b: a for p in long for a, b in zip(p, p[1:]) if a.isalpha()}
        closers = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c in joined and c not in before)
        single = f"[{alone}]|" if alone else ""
        cut = f"{MARK}*[^\\W\\d_]+(?=[{closers}])|" if closers else ""
        self.words = re.compile(f"{single}{cut}{MARK}*[^{MARK}{alone}]+|{MARK}+")

    def weight(self, letter: str) -> int:
        return len(letter.encode()) if self.bytes and letter not in self.rank else 1

    def count(self, word: str) -> int:
        """Tokens of a word: initial symbols less merges."""
        rank, push, pop = self.rank, heapq.heappush, heapq.heappop
        n = len(word)
        last = n - 1
        weights = [1 if c in rank else self.weight(c) for c in word]
        total = sum(weights)
        heap = [(rank[pair], i, 2) for i in range(last) if (pair := word[i:i + 2]) in rank]
        if not heap:
            return total
        heapq.heapify(heap)
        symbols, after, before = list(word), list(range(1, n + 1)), list(range(-1, last))
        while heap:
            _, i, size = pop(heap)
            left, j = symbols[i], after[i]
            # The pair is still there if neither part has grown or gone.
            if j > last or not left or len(left) + len(symbols[j]) != size:
                continue
            total -= weights[i] + weights[j] - 1
            weights[i] = 1
            symbols[i] = left = left + symbols[j]
            symbols[j] = ""
            after[i] = j = after[j]
            if j <= last:
                before[j] = i
                if (pair := left + symbols[j]) in rank:
                    push(heap, (rank[pair], i, len(pair)))
            if (h := before[i]) >= 0 and (pair := symbols[h] + left) in rank:
                push(heap, (rank[pair], h, len(pair)))
        return total


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


class Counter:
    """Counts whole texts; counts of short words already met are kept in a bounded dictionary."""

    def __init__(self, ranks: Ranks, most: int = CACHE_WORDS):
        self.ranks, self.most, self.known = ranks, most, {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.known) > self.most:
            self.known = {}
        known, total = self.known, 0
        for word in self.ranks.words.findall(MARK + text.replace(" ", MARK)):
            n = known.get(word)
            if n is None:
                n = self.ranks.count(word)
                if len(word) <= CACHE_LETTERS:
                    known[word] = n
            total += n
        return total


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens exceed ``limit``; ``path``: the vocabulary, on every executor."""
    small_batches(docs.sparkSession, 500)

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(load(path))
        for texts in parts:
            yield pd.Series([counter(t) for t in texts], dtype="int64")

    count.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.pandas_udf(count, "long")(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())
