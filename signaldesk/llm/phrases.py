"""Phrase collocations from weighted acyclic automata over word n-grams.

1. Every task counts the n-grams of its texts in shards of bounded size.  A shard's sorted n-grams are added one block
   after another to a count transducer: an acyclic automaton whose arcs carry words and, as weight, the occurrences of
   the phrase read so far.  Equal last states are shared.
2. Splitters between prefix ranges come from evenly spaced n-grams of all shards; they only balance the ranges.  Shard
   transducers are cut at them, and in each range their union sums the weights.
3. Candidates name the parts of their cuts.  In each range the acceptor of the parts asked for is composed with the
   range's transducer, which gives the parts' counts.  A first word that several ranges hold has its counts added up.
4. Scores are exact decimals; a candidate mostly inside a longer one goes; the best of each language stay.

An n-gram that a result needs occurs at least as often as the candidate, so only those of ``least`` occurrences leave a
range (and the words at its ends, which may continue in the next one).  A very frequent word is cut by the word after it.

Defined results: a null text counts as empty; a null language is ``und``; repeated rows count each time; an empty table
gives an empty table; other columns play no part; texts are read whole, in slices that overlap by two words.
"""

from __future__ import annotations

import bisect
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from signaldesk.llm.common import LARGE_ROWS, small_batches, staged, table

SHARD_WORDS = 1 << 19      # words of a shard; one text adds at most as many at a time
RANGE_WORDS = 1 << 19      # words that a prefix range should hold
SAMPLES = 64               # n-grams of a shard that shape the ranges
FAN = 2_048                # shards whose parts meet in one union
BITS = 21                  # of a word's number within a shard
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10)
BREAK = b"\xff"            # stands between pieces; no UTF-8 text holds this byte


def words_of(text: bytes | None) -> list[bytes]:
    """Words in A-Z lower case, with BREAK wherever a piece ends."""
    return (text or b"").translate(LOWER).replace(b"\n", b" " + BREAK + b" ").split()


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each span, one span after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def collapse(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of their weights, and the place of every key among them."""
    order = np.argsort(keys, kind="stable")
    new = np.append(True, np.diff(keys[order]) != 0)[:len(keys)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return keys[order][starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0], place


@dataclass
class Transducer:
    """Arcs by depth (0 to 2): word number, weight, and for depths 0 and 1 the target state, a span of the next depth's arcs."""

    words: list[bytes]
    label: list[np.ndarray]
    weight: list[np.ndarray]
    first: list[np.ndarray]
    count: list[np.ndarray]

    def share(self) -> Transducer:
        """Merges last states that have one arc, of the same word and weight; they are most of all states."""
        one = self.count[1] == 1
        at = self.first[1][one]
        if not len(at):
            return self
        arcs = self.label[2][at] * (int(self.weight[2].max()) + 1) + self.weight[2][at]
        _, first, place = np.unique(arcs, return_index=True, return_inverse=True)
        rest = spans(self.first[1][~one], self.count[1][~one])
        start = np.zeros(len(one), np.int64)
        start[one] = place
        counts = self.count[1][~one]
        start[~one] = len(first) + np.cumsum(counts) - counts
        keep = np.concatenate([at[first], rest])
        return Transducer(self.words, [*self.label[:2], self.label[2][keep]], [*self.weight[:2], self.weight[2][keep]], [self.first[0], start], self.count)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted n-grams as rows of three word numbers (-1: none), each with the occurrences that no longer one has."""
        l2 = spans(self.first[0], self.count[0])
        p2 = np.repeat(np.arange(len(self.label[0])), self.count[0])
        l3 = spans(self.first[1][l2], self.count[1][l2])
        p3 = np.repeat(np.arange(len(l2)), self.count[1][l2])
        own1 = self.weight[0] - np.bincount(p2, self.weight[1][l2], len(self.label[0])).astype(np.int64)
        own2 = self.weight[1][l2] - np.bincount(p3, self.weight[2][l3], len(l2)).astype(np.int64)
        none1, none2 = np.full(len(own1), -1), np.full(len(own2), -1)
        rows = np.concatenate([np.stack([self.label[0], none1, none1], 1), np.stack([self.label[0][p2], self.label[1][l2], none2], 1),
                               np.stack([self.label[0][p2[p3]], self.label[1][l2[p3]], self.label[2][l3]], 1)]).astype(np.int64)
        own = np.concatenate([own1, own2, self.weight[2][l3]])
        rows, own = rows[own > 0], own[own > 0]
        order = np.lexsort(rows.T[::-1])
        return rows[order], own[order]

    def dump(self) -> bytes:
        """Words and arrays in the fewest bytes that hold their numbers."""
        text = np.frombuffer(b" ".join(self.words), np.uint8)
        arrays = [text, *map(narrow, (*self.label, *self.weight, *self.first, *self.count))]
        head = np.array([len(arrays), *(v for a in arrays for v in (a.dtype.itemsize, len(a)))], "<i8")
        return head.tobytes() + b"".join(a.tobytes() for a in arrays)

    @staticmethod
    def load(data: bytes) -> Transducer:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        shape = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2)
        at, arrays = 8 + 16 * n, []
        for size, length in shape.tolist():
            arrays.append(np.frombuffer(data, f"<u{size}", length, at))
            at += size * length
        rest = [a.astype(np.int64) for a in arrays[1:]]
        return Transducer(arrays[0].tobytes().split(b" ") if len(arrays[0]) else [], rest[:3], rest[3:6], rest[6:8], rest[8:10])


class Builder:
    """Adds blocks of sorted n-grams to a transducer; the path of the last one stays open between blocks."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.label: list[list[np.ndarray]] = [[], [], []]
        self.weight: list[list[np.ndarray]] = [[], [], []]
        self.parent: list[list[np.ndarray]] = [[], []]   # of depths 1 and 2: number of the arc before
        self.arcs = [0, 0, 0]
        self.last = np.full((1, 3), -2)

    def add(self, rows: np.ndarray, n: np.ndarray) -> None:
        """rows: distinct n-grams in order, after all added before; n: their occurrences as such (no longer n-gram's)."""
        if not len(rows):
            return
        before = np.concatenate([self.last, rows[:-1]])
        fresh = rows[:, 0] != before[:, 0]
        current = None
        for depth in range(3):
            if depth:
                fresh = fresh | (rows[:, depth] != before[:, depth])
            there = rows[:, depth] >= 0
            new = fresh & there
            arc = self.arcs[depth] - 1 + np.cumsum(new)   # the arc that each row passes at this depth
            if depth:
                self.parent[depth - 1].append(current[new])
            made = int(new.sum())
            weight = np.zeros(made + 1, np.int64)         # place 0: the arc that is still open
            np.add.at(weight, (arc - self.arcs[depth] + 1)[there], n[there])
            if weight[0]:
                self.weight[depth][-1][-1] += weight[0]
            if made:
                self.label[depth].append(rows[new, depth])
                self.weight[depth].append(weight[1:])
            self.arcs[depth] += made
            current = arc
        self.last = rows[-1:]

    def done(self) -> Transducer:
        def whole(parts: list[np.ndarray]) -> np.ndarray:
            return np.concatenate(parts) if parts else np.zeros(0, np.int64)

        count = [np.bincount(whole(self.parent[d]).astype(np.int64), minlength=self.arcs[d]) for d in (0, 1)]
        first = [np.cumsum(c) - c for c in count]
        return Transducer(self.words, [whole(x) for x in self.label], [whole(x) for x in self.weight], first, count).share()


def build(words: list[bytes], rows: np.ndarray, n: np.ndarray, block: int = 1 << 16) -> Transducer:
    """The transducer of sorted n-grams over the words that they use."""
    used = np.unique(rows[rows >= 0])
    rows = np.where(rows >= 0, np.searchsorted(used, rows), -1)
    builder = Builder([words[i] for i in used.tolist()])
    for i in range(0, len(rows), block):
        builder.add(rows[i:i + block], n[i:i + block])
    return builder.done()


def union(parts: list[Transducer]) -> Transducer:
    """One transducer whose weights are the sums of the parts' weights."""
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: i for i, w in enumerate(words)}
    maps = [np.array([number[w] for w in p.words], np.int64) for p in parts]
    size = max(1, len(words))
    key = np.concatenate([m[p.label[0]] for m, p in zip(maps, parts)])
    label, weight, place = collapse(key, np.concatenate([p.weight[0] for p in parts]))
    labels, weights, firsts, counts = [label], [weight], [], []
    # The arcs of all parts at this depth, as places in each part, with the new arc of each.
    arcs = [np.arange(len(p.label[0])) for p in parts]
    for depth in (1, 2):
        ends = np.cumsum([len(a) for a in arcs])
        new = np.split(place, ends[:-1])
        held = [p.count[depth - 1][a] for p, a in zip(parts, arcs)]
        below = [spans(p.first[depth - 1][a], c) for p, a, c in zip(parts, arcs, held)]
        parent = np.concatenate([np.repeat(x, c) for x, c in zip(new, held)])
        letter = np.concatenate([m[p.label[depth][b]] for m, p, b in zip(maps, parts, below)])
        key, weight, place = collapse(parent * size + letter, np.concatenate([p.weight[depth][b] for p, b in zip(parts, below)]))
        count = np.bincount(key // size, minlength=len(labels[-1]))
        firsts.append(np.cumsum(count) - count)
        counts.append(count)
        labels.append(key % size)
        weights.append(weight)
        arcs = below
    return Transducer(words, labels, weights, firsts, counts)


def compose(asked: Transducer, counts: Transducer) -> dict[bytes, int]:
    """Phrases that both read, with the weight that counts gives them."""
    number = {w: i for i, w in enumerate(counts.words)}
    turn = np.array([number.get(w, -1) for w in asked.words], np.int64)
    size = len(counts.words) + 1
    mine, theirs = np.arange(len(asked.label[0])), np.arange(len(counts.label[0]))
    left, right = turn[asked.label[0]], counts.label[0]
    heads, found = [b""], {}
    for depth in range(3):
        # Arcs from the same pair of states that read the same word; words that counts lacks are left out first.
        known = np.flatnonzero(turn[asked.label[depth][mine]] >= 0)
        _, i, j = np.intersect1d(left[known], right, assume_unique=True, return_indices=True)
        mine, theirs = mine[known[i]], theirs[j]
        pair = (right[j] // size).tolist() if depth else [0] * len(j)
        heads = [heads[p] + b" " * bool(depth) + counts.words[w] for p, w in zip(pair, counts.label[depth][theirs].tolist())]
        found |= zip(heads, counts.weight[depth][theirs].tolist())
        if depth < 2:
            c, d = asked.count[depth][mine], counts.count[depth][theirs]
            pairs = np.arange(len(mine))
            mine, theirs = spans(asked.first[depth][mine], c), spans(counts.first[depth][theirs], d)
            left = np.repeat(pairs, c) * size + turn[asked.label[depth + 1][mine]]
            right = np.repeat(pairs, d) * size + counts.label[depth + 1][theirs]
    return found


class Shard:
    """Words of one language, as numbers in order of first sight, until they are counted."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.number[BREAK]
        self.ids: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []   # whether an n-gram starts there

    def add(self, words: list[bytes], own: int) -> None:
        """The first ``own`` of the words start n-grams here; the rest only follow them."""
        ids = np.array([*map(self.number.__getitem__, words), 0, 0], np.int64)
        self.ids.append(ids)
        self.starts.append((np.arange(len(ids)) < own) & (ids > 0))

    def sorted_grams(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words in byte order, sorted distinct n-grams (rows of three, -1: none) and their occurrences."""
        words = list(self.number)
        order = sorted(range(1, len(words)), key=words.__getitem__)
        rank = np.zeros(len(words), np.int64)
        rank[order] = np.arange(1, len(words))
        ids = rank[np.concatenate([*self.ids, np.zeros(2, np.int64)])]
        own = np.flatnonzero(np.concatenate(self.starts))
        a, b, c = ids[own], ids[own + 1], ids[own + 2]
        keys, n = np.unique(a << 2 * BITS | b << BITS | np.where(b > 0, c, 0), return_counts=True)
        mask = (1 << BITS) - 1
        return [words[i] for i in order], np.stack([keys >> 2 * BITS, keys >> BITS & mask, keys & mask], 1) - 1, n.astype(np.int64)


def shard_transducers(docs: DataFrame) -> DataFrame:
    """lang, words, the transducer of every shard, and evenly spaced first words and second words of it."""
    small_batches(docs.sparkSession, 500)

    def finish(lang: str, shard: Shard) -> Iterator[dict]:
        words, rows, n = shard.sorted_grams()
        if not len(rows):
            return
        upto = np.cumsum(n)
        at = np.unique(np.searchsorted(upto, upto[-1] * (np.arange(SAMPLES) + 0.5) / SAMPLES))
        yield {"lang": lang, "n": int(upto[-1]), "blob": build(words, rows, n).dump(),
               "w1": [words[i] for i in rows[at, 0]], "w2": [words[i] if i >= 0 else b"" for i in rows[at, 1]]}

    def flush(shards: dict[str, Shard]) -> pd.DataFrame:
        return pd.DataFrame([r for k, s in shards.items() for r in finish(k, s)], columns=["lang", "n", "blob", "w1", "w2"])

    def count(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards: dict[str, Shard] = defaultdict(Shard)
        held, step = 0, SHARD_WORDS >> 1
        for pdf in parts:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                words = words_of(text)
                for i in range(0, len(words), step):
                    part = words[i:i + step + 2]
                    shards[lang].add(part, step)
                    held += len(part)
                    if held >= SHARD_WORDS:
                        yield flush(shards)
                        shards.clear()
                        held = 0
        yield flush(shards)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.col("text").cast("binary").alias("text")).mapInPandas(count, "lang string, n long, blob binary, w1 array<binary>, w2 array<binary>")


def splitters(shards: DataFrame, range_words: int) -> list[tuple[bytes, bytes, bytes]]:
    """Starts of all prefix ranges but the first, as (language, word, next word), in order; one for each ``range_words`` words."""
    sample = shards.select("lang", (F.col("n") / F.size("w1")).alias("n"), F.explode(F.arrays_zip("w1", "w2")).alias("w"))
    key = ["lang", "w1", "w2"]
    # Sorted over partitions and numbered by running sums: inside a partition by its order, between them by their totals.
    ranged = staged(sample.select("lang", "w.w1", "w.w2", "n").repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), "samples")
    totals = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}   # one row a partition
    before = dict(zip(sorted(totals), np.cumsum([0.0, *(totals[p] for p in sorted(totals))])))
    if not totals:
        return []
    starts = ranged.sparkSession.createDataFrame([(p, float(v)) for p, v in before.items()], "part int, before double")
    upto = F.sum("n").over(W.partitionBy("part").orderBy(*key)) + F.col("before")
    cell = F.floor(upto / range_words)
    picked = ranged.join(F.broadcast(starts), "part").withColumn("cell", cell).where("cell > 0").groupBy("cell").agg(F.min(F.struct(F.col("lang").cast("binary").alias("lang"), "w1", "w2")).alias("w"))
    return sorted({(bytes(r["w"]["lang"]), bytes(r["w"]["w1"]), bytes(r["w"]["w2"])) for r in picked.collect()})   # one row a range


def range_blobs(shards: DataFrame, cuts: list[tuple[bytes, bytes, bytes]]) -> DataFrame:
    """range, lang and the part of every shard's transducer that lies in the range."""
    shared = shards.sparkSession.sparkContext.broadcast(cuts)   # a few dozen bytes a range

    def cut(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = shared.value
        for pdf in parts:
            for shard, lang, blob in zip(pdf["shard"], pdf["lang"], pdf["blob"]):
                whole = Transducer.load(blob)
                rows, n = whole.paths()
                name = lang.encode()
                lo, hi = bisect.bisect_left(marks, (name,)), bisect.bisect_left(marks, (name + b"\0",))
                places = [bisect.bisect_left(whole.words, w) for _, w, _ in marks[lo:hi]]
                seconds = [bisect.bisect_left(whole.words, v) if v and at < len(whole.words) and whole.words[at] == w else -1 for at, (_, w, v) in zip(places, marks[lo:hi])]
                size = len(whole.words) + 2
                ends = np.searchsorted(rows[:, 0] * size + rows[:, 1] + 1, np.array(places, np.int64) * size + np.array(seconds, np.int64) + 1)
                ends = [0, *ends.tolist(), len(rows)]
                out = [(lo + k, lang, shard, build(whole.words, rows[a:b], n[a:b]).dump()) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
                yield pd.DataFrame(out, columns=["range", "lang", "shard", "blob"])

    return shards.select("shard", "lang", "blob").mapInPandas(cut, "range long, lang string, shard long, blob binary")


def tree_unions(blobs: DataFrame, shards: int) -> DataFrame:
    """Blobs of one range united in groups of about ``FAN``, until a range has no more than that."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(blob=[union([Transducer.load(b) for b in pdf["blob"]]).share().dump()])

    while shards > FAN:
        shards = -(-shards // FAN)
        blobs = blobs.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(shards)))
        blobs = blobs.groupBy("range", "lang", "shard").applyInPandas(merge, "range long, lang string, shard long, blob binary")
    return blobs


def range_counts(blobs: DataFrame, least: int) -> DataFrame:
    """range, lang, size, phrase, f: the n-grams that occur ``least`` times, and the words at a range's ends."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = union([Transducer.load(b) for b in pdf["blob"]])
        words = total.words
        keep = total.weight[0] >= least
        keep[[0, -1]] = True
        first = np.flatnonzero(keep)
        out = [(1, words[total.label[0][i]], int(total.weight[0][i])) for i in first]
        parent = np.repeat(np.arange(len(total.label[0])), total.count[0])
        second = np.flatnonzero(total.weight[1] >= least)
        out += [(2, words[total.label[0][parent[i]]] + b" " + words[total.label[1][i]], int(total.weight[1][i])) for i in second]
        above = np.repeat(np.arange(len(total.label[1])), total.count[1])
        third = np.flatnonzero(total.weight[2] >= least)
        out += [(3, b" ".join((words[total.label[0][parent[above[i]]]], words[total.label[1][above[i]]], words[total.label[2][i]])), int(total.weight[2][i])) for i in third]
        made = pd.DataFrame(out, columns=["size", "phrase", "f"])
        made["phrase"] = [p.decode() for p in made["phrase"]]
        return made.assign(range=int(pdf["range"].iloc[0]), lang=pdf["lang"].iloc[0])[["range", "lang", "size", "phrase", "f"]]

    return blobs.groupBy("range", "lang").applyInPandas(merge, "range long, lang string, size int, phrase string, f long")


def of_phrases(phrases: Iterable[str], weights: Iterable[int]) -> tuple[Transducer, list[str]]:
    """The transducer of phrases, whose weight is that of the whole phrase alone; and the phrases in its order."""
    pairs = sorted((tuple(p.encode().split(b" ")), p, w) for p, w in zip(phrases, weights))
    words = sorted({w for key, _, _ in pairs for w in key})
    number = {w: i for i, w in enumerate(words)}
    rows = np.array([[*(number[w] for w in key), *[-1] * (3 - len(key))] for key, _, _ in pairs], np.int64).reshape(-1, 3)
    return build(words, rows, np.array([w for _, _, w in pairs], np.int64)), [p for _, p, _ in pairs]


def of_counts(pdf: pd.DataFrame) -> Transducer:
    """The transducer of a range's counts; phrases have the counts of their prefixes on the way."""
    # A prefix's weight is the sum over its path, so each row adds what its own longer rows do not hold.
    f = dict(zip(pdf["phrase"], pdf["f"]))
    own = dict(f)
    for phrase, n in f.items():
        head = phrase.rpartition(" ")[0]
        if head in own:
            own[head] -= n
    return of_phrases(own.keys(), own.values())[0]


def part_counts(parts: DataFrame, counts: DataFrame, cuts: list[tuple[bytes, bytes, bytes]]) -> DataFrame:
    """lang, phrase, f of the phrases asked for, by composition in each range that may hold them."""
    shared = counts.sparkSession.sparkContext.broadcast(cuts)

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = shared.value
        for pdf in batches:
            out = []
            for lang, phrase in zip(pdf["lang"], pdf["phrase"]):
                head = (lang.encode(), *phrase.encode().split(b" ")[:2])
                lo = bisect.bisect_right(marks, head if len(head) == 3 else (*head, b""))
                hi = lo if len(head) == 3 else bisect.bisect_left(marks, (head[0], head[1] + b"\0", b""))
                out += [(r, lang, phrase) for r in range(lo, hi + 1)]
            yield pd.DataFrame(out, columns=["range", "lang", "phrase"])

    def look(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            acceptor, phrases = of_phrases(asked["phrase"], itertools.repeat(1))
            found = compose(acceptor, of_counts(held))
            out = [(held["lang"].iloc[0], p, f) for p in phrases if (f := found.get(p.encode()))]
        return pd.DataFrame(out, columns=["lang", "phrase", "f"])

    asked = parts.mapInPandas(place, "range long, lang string, phrase string")
    looked = asked.groupBy("range", "lang").cogroup(counts.select("range", "lang", "phrase", "f").groupBy("range", "lang")).applyInPandas(look, "lang string, phrase string, f long")
    return looked.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact up to counts of 10^15."""
    whole = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", whole[0] * whole[0] * F.lit(1_000_000).cast("decimal(7,0)"), whole[1] * whole[2]).cast("long")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50, range_words: int = RANGE_WORDS) -> DataFrame:
    """The best phrases of two and three words of every language, see the query's contract: lang, rank, phrase, a, l, r, n, score.

    ``inside``: a candidate goes if a longer one that holds it has at least this share of its count, in percent.
    """
    shards = staged(shard_transducers(docs).withColumn("shard", F.monotonically_increasing_id()), "shards", LARGE_ROWS)
    cuts = splitters(shards, range_words)
    counts = staged(range_counts(tree_unions(range_blobs(shards, cuts), shards.count()), least), "counts")
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))

    words = F.split("phrase", " ")
    candidates = counts.where((F.col("size") > 1) & (F.col("f") >= least)).select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cut_up = candidates.select("lang", "phrase", "size", "a", "w", cut).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cut_up = staged(cut_up, "cuts")
    asked = cut_up.select("lang", F.explode(F.array("left", "right")).alias("phrase")).distinct()
    parts = staged(part_counts(asked, counts, cuts), "parts")

    scored = cut_up.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where("size = 3").select("lang", "a", F.explode(F.array(part(F.lit(1), F.lit(2)), part(F.lit(2), F.lit(2)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


COLLOCATION_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces),
filled AS (SELECT lang, w FROM lists WHERE len(w) > 0),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM filled),
grams AS (
  SELECT lang, 1 AS size, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:size], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM candidates WHERE size = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase WHERE g.longer IS NULL OR 100 * g.longer < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
