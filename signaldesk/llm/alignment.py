"""Alignment of two tokenizers over the same bytes, by fragments that compose.

Both tokenizers cut the bytes of space + text.  Where tokens of both end, a group ends, and the last tokens of its two
sides are linked.  A byte range knows its groups but for those at its ends: it is a ``Fragment`` of an open prefix (up to
the first common end), closed groups, and an open suffix.  Two neighbours compose: suffix and prefix close a group
between them.  Composition is associative, so fragments of one text may be joined in any tree.

1. Texts are cut into units where neither tokenizer can join the sides: before a single space or line feed between
   visible letters.  Units recur, so the fragments of short ones are kept in a bounded dictionary.  A unit longer than
   ``chunk`` bytes (a text without spaces) is aligned in byte ranges that are composed as a tree.
2. A text of over ``long_bytes`` is dealt out in pieces to many tasks; their fragments compose in rounds of ``FAN``.
3. Links are counted for all texts; each text then adds up the counts of its links.

Defined results: a text that is null or empty, or whose tokens do not spell space + text, has no tokens: zeros and an
empty string; null ids stay; repeated rows each count; an empty table gives an empty table; other columns play no part;
texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from signaldesk.llm import bpe, token_counts
from signaldesk.llm.common import small_batches, staged, table

CHUNK = 1 << 15            # bytes of a range inside a unit
LONG_BYTES = 1 << 17       # texts over this are dealt out in pieces
FAN = 16                   # fragments composed at once in a round
CACHE_UNITS = 400_000
CACHE_LETTERS = 48         # longer units are not kept
COUNTED_PAIRS = 1_000_000  # id pairs (24 bytes each) that may be broadcast; more are joined by sorting
#: A unit starts at the front or with a single space or line feed between visible letters.
UNITS = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S+)*(?:\s+\Z)?|\s+\Z")


@dataclass
class Fragment:
    """Groups of a byte range; without a common end in it (``cut`` false) all tokens are in the head."""

    head_a: list[int] = field(default_factory=list)
    head_b: list[int] = field(default_factory=list)
    groups: list[bytes] = field(default_factory=list)    # closed groups, written out; each may hold several, joined by ;
    pairs: list[bytes] = field(default_factory=list)     # their links, as 64-bit numbers
    tail_a: list[int] = field(default_factory=list)
    tail_b: list[int] = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    cut: bool = False
    ok: bool = True


class Pair:
    """Two vocabularies: how they write a group and number a link."""

    def __init__(self, path_a: str, path_b: str, chunk: int = CHUNK):
        from sentencepiece import SentencePieceProcessor

        merges = bpe.MergeTable(path_a)
        merges.special = {}   # their strings are plain text here
        self.a, self.chunk = bpe.Encoder(merges, most=100_000), chunk
        self.b = SentencePieceProcessor(model_file=path_b)
        if any("\n" in p for p in token_counts.load(path_b).rank if len(p) > 1):   # load() also checks that no entry crosses to a blank
            raise ValueError(f"{path_b} has entries that join a line feed")
        ids = range(self.b.get_piece_size())
        mark = token_counts.MARK
        self.bytes_a = merges.bytes
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(mark, " ").encode() for i in ids]
        self.size_b = len(self.bytes_b)
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.known: dict[str, tuple[bytes, bytes, int, bool]] = {}
        # Every id with the sign behind it: A within a group, A before the bar, B within a group, B at its end.
        a, b = range(len(self.bytes_a)), range(self.size_b)
        self.signs = [f"{i},".encode() for i in a] + [f"{i}|".encode() for i in a] + [f"{i},".encode() for i in b] + [f"{i};".encode() for i in b]

    def tokens(self, units: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of A and B of every unit, and whether both spell it."""
        a = [np.frombuffer(x, "<u4").tolist() for x in self.a.encode(units)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        # Before a line feed the blank that B puts in front stays a token of its own.
        b = [x if u[0] == " " else x[1:] for u, x in zip(units, b)]
        out = []
        for u, x, y in zip(units, a, b):
            raw = u.encode()
            out.append((x, y, b"".join(map(self.bytes_a.__getitem__, x)) == raw and b"".join(map(self.bytes_b.__getitem__, y)) == raw))
        return out

    def group(self, a: list[int], b: list[int]) -> bytes:
        return (",".join(map(str, a)) + "|" + ",".join(map(str, b))).encode()

    def link(self, a: list[int], b: list[int]) -> bytes:
        return (a[-1] * self.size_b + b[-1]).to_bytes(8, "little")

    def fragment(self, a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> Fragment:
        """Of the tokens that end in one byte range; ends: their offsets, rising."""
        common = sorted(set(ends_a).intersection(ends_b))
        if not common:
            return Fragment(a, b, n_a=len(a), n_b=len(b))
        out = Fragment(n_a=len(a), n_b=len(b), cut=True)
        i = j = 0
        for k, end in enumerate(common):
            p, q = i, j
            while ends_a[i] != end:
                i += 1
            while ends_b[j] != end:
                j += 1
            i, j = i + 1, j + 1
            if k:
                out.groups.append(self.group(a[p:i], b[q:j]))
                out.pairs.append(self.link(a[p:i], b[q:j]))
            else:
                out.head_a, out.head_b = a[:i], b[:j]
        out.tail_a, out.tail_b = a[i:], b[j:]
        return out

    def join(self, x: Fragment, y: Fragment) -> Fragment:
        """Two neighbouring ranges as one."""
        n = {"n_a": x.n_a + y.n_a, "n_b": x.n_b + y.n_b, "ok": x.ok and y.ok, "cut": x.cut or y.cut}
        if not x.cut:
            return Fragment(x.head_a + y.head_a, x.head_b + y.head_b, y.groups, y.pairs, y.tail_a, y.tail_b, **n)
        tail_a, tail_b = x.tail_a + y.head_a, x.tail_b + y.head_b
        if not y.cut:
            return Fragment(x.head_a, x.head_b, x.groups, x.pairs, tail_a, tail_b, **n)
        return Fragment(x.head_a, x.head_b, [*x.groups, self.group(tail_a, tail_b), *y.groups], [*x.pairs, self.link(tail_a, tail_b), *y.pairs], y.tail_a, y.tail_b, **n)

    def tree(self, parts: list[Fragment]) -> Fragment:
        """All parts in order, composed pair by pair."""
        while len(parts) > 1:
            parts = [reduce(self.join, parts[i:i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else Fragment()

    def ranges(self, a: list[int], b: list[int]) -> list[Fragment]:
        """Fragments of the byte ranges of ``chunk`` bytes; a token belongs to the range that it ends in."""
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        stops = np.arange(self.chunk, int(ends_a[-1]) + self.chunk, self.chunk)
        cut_a, cut_b = ([0, *np.searchsorted(e, stops, side="right").tolist()] for e in (ends_a, ends_b))
        ends_a, ends_b = ends_a.tolist(), ends_b.tolist()
        return [self.fragment(a[p:q], ends_a[p:q], b[r:s], ends_b[r:s]) for p, q, r, s in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]

    def closed(self, x: Fragment) -> tuple[bytes, bytes, int, bool]:
        """All groups, links and token numbers of a range whose ends are common ends."""
        if not x.ok or not x.cut or x.tail_a or x.tail_b:
            return b"", b"", 0, False
        return b";".join([self.group(x.head_a, x.head_b), *x.groups]), b"".join([self.link(x.head_a, x.head_b), *x.pairs]), x.n_a << 32 | x.n_b, True

    def closed_many(self, parts: list[tuple[list[int], list[int]]]) -> Iterator[tuple[bytes, bytes, int, bool]]:
        """``closed`` of many short units at once: their offsets follow one another, and all common ends are found by one search."""
        n_a, n_b = (np.array([len(p[k]) for p in parts], np.int64) for k in (0, 1))
        a, b = (np.fromiter((i for p in parts for i in p[k]), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at = np.searchsorted(ends_b, ends_a)
        hit = ends_b[at] == ends_a
        last_b = np.zeros(len(b), bool)
        last_b[at[hit]] = True
        links = a[hit] * self.size_b + b[at[hit]]
        group_a, group_b = np.cumsum(hit) - hit, np.cumsum(last_b) - last_b
        held_a, held_b = np.bincount(group_a), np.bincount(group_b)
        before_b, upto_a = np.cumsum(held_b) - held_b, np.cumsum(held_a)
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + before_b[group_a]] = a + len(self.bytes_a) * hit
        line[np.arange(len(b)) + upto_a[group_b]] = b + 2 * len(self.bytes_a) + self.size_b * last_b
        line, links = line.tolist(), links.astype("<i8").tobytes()
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        stop_link = 8 * np.cumsum(hit)[stop_a - 1]
        start, first, sign = 0, 0, self.signs.__getitem__
        for stop, link, n in zip((stop_a + stop_b).tolist(), stop_link.tolist(), (n_a << 32 | n_b).tolist()):
            yield b"".join(map(sign, line[start:stop]))[:-1], links[first:link], n, True
            start, first = stop, link

    def learn(self, units: Iterable[str]) -> dict[str, tuple[bytes, bytes, int, bool]]:
        """What is known of the units; long ones are made for this call alone."""
        if len(self.known) > CACHE_UNITS:
            self.known = {}
        wanted = set(units)
        new = list(wanted - self.known.keys())
        out = {}
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            made = self.tokens(part)
            short = [k for k, (u, x) in enumerate(zip(part, made)) if x[2] and len(u) <= self.chunk >> 2]
            closed = dict(zip(short, self.closed_many([made[k][:2] for k in short]))) if short else {}
            for k, (u, (a, b, ok)) in enumerate(zip(part, made)):
                found = closed.get(k) or (self.closed(self.tree(self.ranges(a, b))) if ok else (b"", b"", 0, False))
                (self.known if len(u) <= CACHE_LETTERS else out)[u] = found
        if not out:
            return self.known
        return {u: out.get(u) or self.known[u] for u in wanted}

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, int, bool]]:
        """Groups, links, token numbers and validity of pieces of text that start with a unit's first letter."""
        split = [UNITS.findall(t) for t in texts]
        known = self.learn(u for units in split for u in units)
        for units in split:
            found = [known[u] for u in units]
            if units and all(f[3] for f in found):
                yield b";".join([f[0] for f in found]), b"".join([f[1] for f in found]), sum(f[2] for f in found), True
            else:
                yield b"", b"", 0, False


@lru_cache(maxsize=1)
def load(path_a: str, path_b: str, chunk: int) -> Pair:
    return Pair(path_a, path_b, chunk)


SUMMARY = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def summary(found: tuple[bytes, bytes, int, bool]) -> tuple:
    groups, links, n, ok = found
    if not ok:
        return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
    pairs, times = np.unique(np.frombuffer(links, "<i8"), return_counts=True)
    return n >> 32, n & 0xFFFFFFFF, len(links) // 8, hashlib.sha256(groups).hexdigest(), pairs, times.astype(np.int32)


def frame(ids: pd.Series, key: str, found: Iterable[tuple[bytes, bytes, int, bool]]) -> pd.DataFrame:
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    columns = dict(zip(names, zip(*map(summary, found)))) or {c: [] for c in names}
    return pd.DataFrame({key: ids} | {c: pd.Series(list(v), index=ids.index, dtype=object) for c, v in columns.items()})


def short_texts(docs: DataFrame, path_a: str, path_b: str, chunk: int) -> DataFrame:
    """doc_id and the summary of every text."""
    def align(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = load(path_a, path_b, chunk)
        for pdf in parts:
            yield frame(pdf["doc_id"], "doc_id", pair.texts([f" {t}" if t else "" for t in pdf["text"]]))

    return docs.select("doc_id", "text").mapInPandas(align, f"doc_id {dict(docs.dtypes)['doc_id']}, {SUMMARY}")


FRAGMENT = "head_a array<int>, head_b array<int>, groups binary, pairs binary, tail_a array<int>, tail_b array<int>, n_a long, n_b long, cut boolean, ok boolean"
FIELDS = [c.split()[0] for c in FRAGMENT.split(", ")]


def to_row(x: Fragment) -> list:
    return [x.head_a, x.head_b, b";".join(x.groups), b"".join(x.pairs), x.tail_a, x.tail_b, x.n_a, x.n_b, x.cut, x.ok]


def from_row(r) -> Fragment:
    return Fragment(r.head_a.tolist(), r.head_b.tolist(), [r.groups] if r.groups else [], [r.pairs] if r.pairs else [], r.tail_a.tolist(), r.tail_b.tolist(), r.n_a, r.n_b, r.cut, r.ok)


def long_texts(docs: DataFrame, path_a: str, path_b: str, chunk: int, piece: int, fan: int) -> DataFrame:
    """As ``short_texts``, for texts whose pieces are spread over tasks."""
    small_batches(docs.sparkSession, 500)
    docs = staged(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "long")

    def cut(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row, text in zip(pdf["row"], pdf["text"]):
                text, start, at, out = f" {text}", 0, 0, []
                for unit in UNITS.finditer(text):
                    if unit.end() - start >= piece or unit.end() == len(text):
                        out.append((row, at, text[start:unit.end()]))
                        start, at = unit.end(), at + 1
                yield pd.DataFrame(out, columns=["row", "at", "text"])

    def align(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = load(path_a, path_b, chunk)
        for pdf in parts:
            out = []
            for row, at, text in zip(pdf["row"], pdf["at"], pdf["text"]):
                found = []
                for a, b, ok in pair.tokens(UNITS.findall(text)):
                    found += pair.ranges(a, b) if ok else [Fragment(ok=False)]
                out.append([row, at, *to_row(pair.tree(found))])
            yield pd.DataFrame(out, columns=["row", "at", *FIELDS])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = load(path_a, path_b, chunk)
        pdf = pdf.sort_values("at")
        joined = pair.tree([from_row(r) for r in pdf.itertuples()])
        return pd.DataFrame([[pdf["row"].iloc[0], pdf["at"].iloc[0] // fan, *to_row(joined)]], columns=["row", "at", *FIELDS])

    def finish(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = load(path_a, path_b, chunk)
        for pdf in parts:
            yield frame(pdf["row"], "row", [pair.closed(from_row(r)) for r in pdf.itertuples()])

    schema = f"row long, at long, {FRAGMENT}"
    pieces = docs.select("row", "text").mapInPandas(cut, "row long, at long, text string").repartition("row", "at")
    fragments = staged(pieces.mapInPandas(align, schema), "fragments")
    most = fragments.agg(F.max("at")).first()[0] or 0
    while most:
        fragments = staged(fragments.withColumn("up", F.floor(F.col("at") / fan)).groupBy("row", "up").applyInPandas(lambda pdf: compose(pdf.drop(columns="up")), schema), "fragments")
        most //= fan
    return docs.select("row", "doc_id").join(fragments.mapInPandas(finish, f"row long, {SUMMARY}"), "row").drop("row")


def vocabulary_size(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def link_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, count, best: how many links of all texts hold each id pair, and whether no pair of its B id has more."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    links = staged(links, "links")
    most = links.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("most"))
    return links.withColumn("b", F.col("pair") % size_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, long_bytes: int = LONG_BYTES, piece: int = CHUNK, fan: int = FAN,
                    counted: int = COUNTED_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; paths: the vocabularies, on every executor."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    is_long = F.octet_length("text") > long_bytes
    docs = docs.select("doc_id", "text")
    aligned = short_texts(docs.where(F.coalesce(~is_long, F.lit(True))), path_a, path_b, chunk).unionByName(long_texts(docs.where(is_long), path_a, path_b, chunk, piece, fan))
    aligned = staged(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    size_b = vocabulary_size(path_b)
    counts = staged(link_counts(aligned, size_b), "counts")
    # Rows of fixed width: their number bounds what is broadcast.
    counts = F.broadcast(counts) if counts.count() <= counted else counts.hint("merge")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *(F.coalesce(c, none).alias(c) for c in ("n_links", "n_best", "count_sum")), "groups_sha256")


def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), bpe.vocabulary_path(), token_counts.vocabulary_path())
