"""SimHash near-duplicates through a vantage-point tree over fingerprints.

1. Texts become 64-bit fingerprints of their word shingles; equal fingerprints become one node (grouping, no pairs).
2. A vantage-point tree, built on a bounded sample, deals all nodes to leaves by Hamming distance (and, where word
   counts must be alike, to bands of their logarithm within a leaf).  The sample only
   shapes the tree: by the triangle bound a node visits every leaf across a boundary it is within ``radius`` of, so no
   pair is lost.  Of two leaves the later one compares, so a pair is met once.
3. Each leaf compares its own nodes with each other and with its visitors, and gives a spanning forest of what it found:
   at most one edge a node, however many copies lie close together.  Leaves that no boundary can split are dealt out in
   blocks.
4. Large-star and small-star rounds over written edge tables join the forests to components.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows and repeated ids
each keep their row; null ids take part but never name a component (null if no id of the component is known); an empty
table gives an empty table; other columns play no part; texts are read whole.

The pipeline's near copies go through the same fingerprints and tree first; each link is then decided by the similarity of the
shingle sets themselves, and bands of minima find the similar pairs that no fingerprint links; see ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from signaldesk.llm.common import bucketed, discard, fresh, small_batches, staged, table

SAMPLE = 1 << 15         # fingerprints that shape the tree
LEAF = 2_000             # nodes a leaf should hold
SEED = 42
SIMILAR = (4, 5)         # least similarity of near copies in the pipeline, as a fraction
BANDS, ROWS = 24, 5      # minima that find its candidates
GROUP = 256              # pairs of a leader that are checked together
MIX = np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes | None) -> list[bytes]:
    """Words in A-Z lower case; bytes.split() cuts at space and ASCII controls 9 to 13."""
    return (text or b"").translate(LOWER).split()


def fingerprint(words: list[bytes], size: int) -> int:
    """A bit is 1 if over half of the shingle hashes (repeats included) have it set; no words: 0."""
    if not words:
        return 0
    parts = words if size == 1 else [b" ".join(g) for g in zip(*(words[k:] for k in range(size)))] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(parts), 1 << 16):
        h = np.array([digest(p, SEED) for p in parts[i:i + (1 << 16)]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(parts)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingles: tuple[int, ...], keep: list[str]) -> DataFrame:
    """Columns of ``keep``, fp0, fp1, ... for each shingle size, and n_words."""
    small_batches(docs.sparkSession)
    names = [f"fp{i}" for i in range(len(shingles))]

    def batches(parts):
        for pdf in parts:
            words = [words_of(t) for t in pdf.pop("_text")]
            for name, size in zip(names, shingles):
                pdf[name] = np.array([fingerprint(w, size) for w in words], np.int64)
            pdf["n_words"] = np.array([len(w) for w in words], np.int64)
            yield pdf

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{n} long" for n in names), "n_words long"])
    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInPandas(batches, schema)


@dataclass
class Tree:
    """vantage, bound and the two children of each inner node; a child below 0 is leaf -1 - child."""

    vantage: list[int] = field(default_factory=list)
    bound: list[int] = field(default_factory=list)
    near: list[int] = field(default_factory=list)
    far: list[int] = field(default_factory=list)
    leaves: int = 0
    root: int = -1

    def walk(self, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places in fps that are home there or visit it, whether each is home)."""
        todo = [(self.root, np.arange(len(fps)), np.ones(len(fps), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at, home
                continue
            d = np.bitwise_count(fps[at] ^ np.uint64(self.vantage[node])).astype(np.int64)
            b = self.bound[node]
            for child, go, own in ((self.near[node], d <= b + radius, d <= b), (self.far[node], d > b - radius, d > b)):
                todo.append((child, at[go], (home & own)[go]))


def build_tree(sample: np.ndarray, leaf: int, radius: int, seed: int = 11, tries: int = 24) -> Tree:
    """Splits at vantage points and bounds that balance the sides and leave few fingerprints near the boundary."""
    tree, rng = Tree(), np.random.default_rng(seed)

    def grow(points: np.ndarray) -> int:
        best = None
        if len(points) > leaf:
            for v in rng.choice(points, min(tries, len(points)), replace=False):
                c = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65)) / len(points)
                for b in range(64):
                    if 0.25 <= c[b] <= 0.75:
                        twice = c[min(64, b + radius)] - (c[b - radius] if b >= radius else 0)
                        cost = (c[b] ** 2 + (1 - c[b]) ** 2) + 1.5 * twice
                        if best is None or cost < best[0]:
                            best = cost, int(v), b
        if best is None:
            tree.leaves += 1
            return -tree.leaves
        _, v, b = best
        at = len(tree.vantage)
        tree.vantage.append(v), tree.bound.append(b), tree.near.append(0), tree.far.append(0)
        inside = np.bitwise_count(points ^ np.uint64(v)) <= b
        tree.near[at] = grow(points[inside])
        tree.far[at] = grow(points[~inside])
        return at

    tree.root = grow(sample)
    return tree


@dataclass(frozen=True)
class Link:
    """Two nodes link if fp0 differs in at most ``radius`` bits and, where set, the further tests hold."""

    radius: int = 2
    second: int | None = None        # most differing bits of fp1
    size_ratio: float | None = None  # least ratio of the word counts


def _forest(link: Link):
    def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        while len(i):
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
        return label

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("home", ascending=False, kind="stable")
        n_home = int(pdf["home"].sum())
        fp = pdf["fp0"].to_numpy().view(np.uint64)
        second = pdf["fp1"].to_numpy().view(np.uint64) if link.second is not None else None
        size = pdf["n_words"].to_numpy()
        label = np.arange(len(pdf))
        for a in range(0, len(pdf), 512):
            i, j = np.nonzero(np.bitwise_count(fp[a:a + 512, None] ^ fp[None, :n_home]) <= link.radius)
            i += a
            ok = i > j
            if second is not None:
                ok &= np.bitwise_count(second[i] ^ second[j]) <= link.second
            if link.size_ratio is not None:
                ok &= np.minimum(size[i], size[j]) >= link.size_ratio * np.maximum(size[i], size[j])
            label = merge(label, i[ok], j[ok])
        child = np.flatnonzero(label != np.arange(len(pdf)))
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"a": node[child], "b": node[label[child]]})

    return forest


def near_edges(nodes: DataFrame, link: Link, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) that join all linked nodes; nodes: node, fp0, fp1, n_words, written already."""
    spark = nodes.sparkSession
    # Word counts within the ratio lie in the same or in neighbouring bands of their logarithm.
    width = -math.log(link.size_ratio) * (1 + 1e-9) if link.size_ratio is not None else None

    def band_of(size: np.ndarray) -> np.ndarray:
        return (np.log(np.maximum(size, 1)) / width).astype(np.int64) if width else np.zeros(len(size), np.int64)

    places = nodes.groupBy((F.floor(F.log(F.greatest("n_words", F.lit(1))) / width) if width else F.lit(0)).alias("band")).agg(F.count("*").alias("n"))
    counts = np.array([r["n"] for r in places.collect()], float)  # one row a band
    n = int(counts.sum())
    spread = n * n / max(1.0, (counts ** 2).sum())
    picked = nodes.select("fp0").distinct().orderBy(F.xxhash64("fp0"), "fp0").limit(sample).toPandas()["fp0"].to_numpy(np.int64).view(np.uint64)
    tree = build_tree(picked, max(8, int(leaf * spread * len(picked)) // max(1, n)), link.radius)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")

    def homes(parts):
        for pdf in parts:
            fp, band = pdf["fp0"].to_numpy().view(np.uint64), band_of(pdf["n_words"].to_numpy())
            for at, own, home in tree.walk(fp, 0):
                bands, k = np.unique(band[own[home]], return_counts=True)
                yield pd.DataFrame({"leaf": at, "band": bands, "n": k})

    held = nodes.select("fp0", "n_words").mapInPandas(homes, "leaf long, band long, n long").groupBy("leaf", "band").agg(F.sum("n").alias("n")).toPandas()
    # Cells: (leaf, band) with a home, at most leaves x bands; large ones are cut into blocks.
    n_bands = int(held["band"].max()) + 1 if len(held) else 1
    blocks, first = np.zeros((tree.leaves, n_bands), np.int64), np.zeros((tree.leaves, n_bands), np.int64)
    held = held.sort_values(["leaf", "band"])
    blocks[held["leaf"], held["band"]] = -(-held["n"].to_numpy() // (2 * leaf))
    first.flat[1:] = np.cumsum(blocks)[:-1]

    def deal(parts):
        for pdf in parts:
            fp, band = pdf["fp0"].to_numpy().view(np.uint64), band_of(pdf["n_words"].to_numpy())
            # A visitor goes only to cells after its own, so its home leaf is found first.
            own = np.zeros(len(fp), np.int64)
            found = list(tree.walk(fp, link.radius))
            for at, rows, home in found:
                own[rows[home]] = at
            block = (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for at, rows, home in found:
                for step in (-1, 0, 1) if width else (0,):
                    there = band[rows] + step
                    stays = home & (step == 0)
                    go = (there >= 0) & (there < n_bands) & (stays | (own[rows] < at) | ((own[rows] == at) & (step > 0)))
                    go[go] = blocks[at, there[go]] > 0
                    some, cell, stay, parted = rows[go], first[at, there[go]], stays[go], blocks[at, there[go]]
                    mine = block[some] % np.maximum(parted, 1)
                    for b in range(int(parted.max(initial=0))):
                        take = (parted > b) & (~stay | (mine <= b))
                        out.append((some[take], (cell + b)[take], (stay & (mine == b))[take]))
            if out:
                some, cell, stay = (np.concatenate(x) for x in zip(*out))
                yield pdf.iloc[some].assign(home=stay, cell=cell)

    kinds = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    dealt = nodes.mapInPandas(deal, f"{kinds}, home boolean, cell long")
    return dealt.groupBy("cell").applyInPandas(_forest(link), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root: the smallest node of its component.

    Star rounds over written tables: minima are pre-aggregated, and a hub only meets its own minimum in the join.
    """

    def mark(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def step(pairs, emit):
        return emit(pairs.join(pairs.groupBy("a").agg(F.min("b").alias("m")), "a"))

    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = mark(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = step(both, lambda j: j.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        large = staged(large.distinct(), "large")
        small = step(large, lambda j: j.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b"))
        old, edges = edges, staged(small.distinct(), "edges")
        discard(old, large)
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group_documents(docs: DataFrame, shingles: tuple[int, ...], link: Link, keep: list[str], order: str) -> DataFrame:
    """Columns of ``keep``, fingerprints, n_words and ``component``: the smallest ``order`` value of the row's group."""
    prints = [f"fp{i}" for i in range(len(shingles))]
    key = prints + (["n_words"] if link.size_ratio is not None else [])
    rows = staged(fingerprints(docs, shingles, keep), "prints")
    nodes = rows.groupBy(*key).agg(F.min(order).alias("first"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    slim = nodes.select("node", *prints, *([] if "n_words" in key else [F.lit(0).cast("long").alias("n_words")]), *(["n_words"] if "n_words" in key else []))
    stars = staged(components(near_edges(slim, link)), "stars")
    linked = staged(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "first"), "node"), "linked")
    least = staged(linked.groupBy("root").agg(F.min("first").alias("least")), "least")
    linked = staged(linked.join(least, "root").select("node", "least"), "linked")
    named = staged(nodes.join(linked, "node", "left").select(*key, F.coalesce("least", "first").alias("component")), "named")
    return rows.join(named, key)


def shingles_of(text: bytes | None, size: int = 5) -> set[bytes]:
    """Distinct shingles of ``size`` words; a shorter text is one shingle, a text without words has none."""
    words = words_of(text)
    return {b" ".join(g) for g in zip(*(words[k:] for k in range(size)))} or ({b" ".join(words)} if words else set())


def band_keys(shingles: set[bytes]) -> tuple[bytes, list[int]]:
    """The digest of a shingle set and a hash of each band of its minima."""
    h = np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))
    if not len(h):
        return b"", []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1 << 12):
        least = np.minimum(least, ((h[i:i + (1 << 12)] ^ MIX[0, :, None]) * MIX[1, :, None]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64)
    return xxhash.xxh3_128_digest(h.tobytes()), keys.view(np.int64).tolist()


def shingle_bands(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns of ``keep``, the digest and size of the text's five-word shingle set, its band keys, and the fingerprint of the text's three-word shingles."""
    small_batches(docs.sparkSession)

    def batches(parts):
        for pdf in parts:
            texts = pdf.pop("_text")
            sets = [shingles_of(t) for t in texts]
            found = [band_keys(s) for s in sets]
            prints = np.array([fingerprint(words_of(t), 3) for t in texts], np.int64)
            yield pdf.assign(digest=[f[0] for f in found], n=[len(s) for s in sets], bands=[f[1] for f in found], fp0=prints)

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "digest binary, n long, bands array<long>, fp0 long"])
    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInPandas(batches, schema)


def linked_pairs(nodes: DataFrame, link: Link) -> DataFrame:
    """(leader, node), written: each node that fingerprints link to others, with one of them; nodes: node, fp0, written already.

    Nodes of one fingerprint meet its smallest node; the fingerprints themselves are linked through the tree.
    """
    prints = staged(nodes.groupBy("fp0").agg(F.min("node").alias("node")).withColumn("n_words", F.lit(0).cast("long")), "prints")
    equal = nodes.join(prints.select("fp0", F.col("node").alias("leader")), "fp0").where("node <> leader").select("leader", "node")
    across = near_edges(prints, link).select(F.col("b").alias("leader"), F.col("a").alias("node"))
    found = staged(equal.unionByName(across).distinct(), "linked")
    discard(prints)
    return found


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (leader, node) whose texts have a Jaccard similarity of at least SIMILAR over their five-word shingles.

    A leader's pairs are dealt to groups of about ``GROUP``; a group gets each member's text and the leader's text once.
    ``texts`` is bucketed by node, so it is neither exchanged nor sorted: it is read past the pairs of its bucket.
    """
    small_batches(pairs.sparkSession, 200)
    held = pairs.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(held, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), "groups").alias("group"))
    members = dealt.hint("shuffle_hash").join(texts, "node").select("leader", "group", "node", F.col("text").alias("right"))
    leaders = dealt.select("leader", "group").distinct().hint("shuffle_hash").join(texts.select(F.col("node").alias("leader"), F.col("text").alias("left")), "leader")
    both = members.join(leaders.hint("merge"), ["leader", "group"]).select("leader", "node", "left", "right")

    def check(parts):
        last, x = None, set()
        for pdf in parts:
            ok = np.zeros(len(pdf), bool)
            for i, (leader, left, right) in enumerate(zip(pdf["leader"], pdf["left"], pdf["right"])):
                if leader != last:
                    last, x = leader, shingles_of(left)
                y = shingles_of(right)
                shared = len(x & y)
                ok[i] = SIMILAR[1] * shared >= SIMILAR[0] * (len(x) + len(y) - shared)
            yield pd.DataFrame({"a": pdf["leader"][ok], "b": pdf["node"][ok]})

    return staged(both.mapInPandas(check, "a long, b long"), "similar")


def rare_shingles(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, node, n, degree, pos): the rarest shingles of each node, and the place of each in the node's own order.

    Every node orders its shingles by the number of ``nodes`` that hold them, rarest first.  Two similar sets share a shingle
    that comes early in both: before it lie only shingles that the other lacks.  So a node is filed under the first
    n - SIMILAR * n + 1 of them; those that no other node holds only move the others back.
    """
    small_batches(nodes.sparkSession, 200)

    def hashes(parts):
        for pdf in parts:
            found = [np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles_of(t)], np.uint64)).view(np.int64) for t in pdf["text"]]
            size = np.array([len(f) for f in found], np.int64)
            yield pd.DataFrame({"bucket": np.concatenate(found), "node": np.repeat(pdf["node"].to_numpy(), size),
                                "n": np.repeat(size, size), "degree": np.repeat(pdf["degree"].to_numpy(), size)})

    held = nodes.hint("shuffle_hash").join(texts, "node").select("node", "degree", "text")
    held = staged(held.mapInPandas(hashes, "bucket long, node long, n long, degree long"), "shingles")
    known = held.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    last = F.row_number().over(W.partitionBy("node").orderBy(F.desc("k"), F.desc("bucket")))
    placed = held.hint("merge").join(known, "bucket").withColumn("pos", F.col("n") - last)
    early = staged(placed.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1])).select("bucket", "node", "n", "degree", "pos"), "early")
    discard(held)
    return early


def similar_components(nodes: DataFrame, texts: DataFrame, link: Link = Link(2)) -> DataFrame:
    """(node, root) of the components over all similar pairs; nodes: node, n, bands, fp0, written already; texts: node, text, bucketed by node.

    Fingerprints come first: what they link is checked by its shingles and joined.  Similar pairs whose fingerprints lie
    further apart share a band of minima.  In a first round one member of each bucket leads: it is checked against all others of
    the bucket that are not in its component yet.  The members that meet most others lead first: the text that a group of copies
    was made of is nearer to all of them than they are to each other, so such a group costs about one pair a member.

    Where a bucket still holds several components, most members are like no other, and bands would have each of them checked
    against all.  So these nodes are filed anew under their rare shingles (``rare_shingles``), which all similar pairs share, and
    led in rounds there: a pair is checked only if what lies behind the shared shingle can still make it similar.  A leader leaves
    its bucket, and a bucket is done when one component holds the rest of it, so every similar pair is found or joined already.
    """
    tested = linked_pairs(nodes.select("node", "fp0"), link)
    stars = staged(components(similar_pairs(tested, texts)), "stars")
    members = staged(nodes.select(F.explode("bands").alias("bucket"), "node", "n"), "members")
    shared = members.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    met = staged(members.join(shared, "bucket"), "met")
    degrees = met.groupBy("node").agg(F.sum("k").alias("degree"))
    all_members = staged(met.drop("k").join(degrees, "node").withColumn("pos", F.lit(0).cast("long")), "shared")
    discard(members, met)
    members, lead, filed, read = all_members, 1, False, [all_members]
    while True:
        rooted = staged(members.join(stars, "node", "left").select("bucket", "node", "n", "degree", "pos", F.coalesce("root", "node").alias("root")), "rooted")
        discard(*read)
        parts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("k"))
        main = parts.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("parts"))
        main = staged(main.where("parts > 1").select("bucket", "main"), "main")
        if main.isEmpty():
            discard(rooted, main)
            return stars
        left = staged(rooted.join(main, "bucket"), "left")
        discard(rooted, main)
        if lead > 1 and not filed:
            members, lead, filed = rare_shingles(left.select("node", "degree").distinct(), texts), 1, True
            discard(left)
            read = [members]
            continue
        nth = F.row_number().over(W.partitionBy("bucket", F.col("root") == F.col("main")).orderBy("pos", F.desc("degree"), "node"))
        leaders = left.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("root") == F.col("main"), 1).otherwise(lead))
        leaders = staged(leaders.select("bucket", F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("pos").alias("leader_pos"), F.col("root").alias("leader_root")), "leaders")
        # What the two can share at most: for bands (place 0) the lesser size, so the ratio of the sizes bounds the similarity.
        most = F.least(F.col("n") - F.col("pos"), F.col("leader_n") - F.col("leader_pos"))
        fits = most * sum(SIMILAR) >= (F.col("n") + F.col("leader_n")) * SIMILAR[0]
        met = left.join(leaders, "bucket").where((F.col("root") != F.col("leader_root")) & fits)
        # Of two leaders that meet, the smaller one leads.
        pairs = met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), (F.col("leader") < F.col("node")).alias("first"))
        pairs = pairs.groupBy("a", "b").agg(F.max("first").alias("first")).select(
            F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(F.col("first"), F.col("b")).otherwise(F.col("a")).alias("node"))
        seen = tested.unionByName(tested.select(F.col("node").alias("leader"), F.col("leader").alias("node")))
        pairs = staged(pairs.join(seen, ["leader", "node"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        edges = similar_pairs(pairs, texts)
        if not edges.isEmpty():
            old, stars = stars, staged(components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges)), "stars")
            discard(old)
        discard(edges)
        members = left.select("bucket", "node", "n", "degree", "pos").join(leaders.select("bucket", F.col("leader").alias("node")), ["bucket", "node"], "left_anti")
        read = [left, leaders]
        lead *= 64


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group stays: that of the smallest id (of equal ids, one row).

    Groups: components of the texts whose five-word shingles have a Jaccard similarity of at least 0.8.  SimHash
    fingerprints through the tree find the closest, and minima of the shingle hashes the other candidates (texts that agree in
    all five minima of one of 24 bands: at a similarity of 0.8 all but 7 in 100,000 pairs); each candidate is decided by its
    shingles.
    """
    cols = docs.columns
    row = fresh(cols, "row_")
    # The rows are written once with a number, in buckets of it: no text is exchanged again but for the pairs to check.
    numbered = bucketed(docs.withColumn(row, F.monotonically_increasing_id()), row)
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col(row).alias("at")).alias("who")
    rows = staged(shingle_bands(numbered.select(who, "text"), ["who"]), "bands")
    # A text stands for all of its shingle set; its row number is the node.
    firsts = rows.groupBy("digest").agg(F.min(F.struct("who", "n", "bands", "fp0")).alias("first"))
    nodes = staged(firsts.select(F.col("first.who").alias("first"), "first.n", "first.bands", "first.fp0", F.col("first.who.at").alias("node")), "nodes")
    discard(rows)
    texts = numbered.select(F.col(row).alias("node"), F.col("text").cast("binary").alias("text"))
    stars = similar_components(nodes.select("node", "n", "bands", "fp0"), texts)
    rooted = staged(nodes.select("node", "first").join(stars, "node", "left").select(F.coalesce("root", "node").alias("root"), "first"), "rooted")
    chosen = staged(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.at").alias(row)), "chosen")
    discard(nodes, stars, rooted)
    return numbered.join(chosen, row, "left_semi").select(*cols)


def simhash_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = group_documents(docs, (3,), Link(2), ["doc_id"], "doc_id")
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
