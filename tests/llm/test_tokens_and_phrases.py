"""Phrases, token counts and alignment against plain versions on small fixtures."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signaldesk.llm import alignment, bpe, phrases, token_counts

LETTERS = "ab e    \n\n\r\t;)}é梦ﬁx\x00\x0c'́😀the<s> \x1c"


def texts(n: int, seed: int, letters: str = LETTERS) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def piece_model():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=token_counts.vocabulary_path())


@pytest.fixture(scope="module")
def byte_model():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(bpe.vocabulary_path())
    model.encode_special_tokens = True
    return model


# Token counts ---------------------------------------------------------------------------------------------------------

def test_counts_equal_the_library(piece_model):
    count = token_counts.Counter(token_counts.load(token_counts.vocabulary_path()), most=50)
    some = texts(3000, 1, LETTERS + "▁") + ["x" * 3000, " " * 999, "=" * 1001, "\r" * 77, "ab" * 5000, "<s></s><unk><0x0A>", "梦" * 500, ""]
    assert [count(t) for t in some] == [len(piece_model.encode(t)) for t in some]


def test_token_counts_of_documents(docs, none, piece_model):
    found = token_counts.token_counts(docs, token_counts.vocabulary_path(), limit=100)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = sorted(map(tuple, found.collect()), key=str)
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(piece_model.encode(r["text"] or ""))) for r in docs.collect()]
    assert rows == sorted(((*w, w[2] > 100) for w in want), key=str)
    assert token_counts.token_counts(none, token_counts.vocabulary_path()).count() == 0


# Alignment ------------------------------------------------------------------------------------------------------------

def plain_alignment(text, byte_model, piece_model):
    """n_a, n_b, groups as written, links; None where the tokens do not spell space + text."""
    if not text:
        return None
    letters = bpe.byte_letters()
    a, b = byte_model.encode(" " + text, add_special_tokens=False).ids, piece_model.encode(text)
    side_a = [bytes(letters[c] for c in byte_model.id_to_token(i)) for i in a]
    side_b = [bytes([i - 3]) if piece_model.is_byte(i) else piece_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    raw = (" " + text).encode()
    if b"".join(side_a) != raw or b"".join(side_b) != raw:
        return None
    ends_a, ends_b = (list(itertools.accumulate(map(len, s))) for s in (side_a, side_b))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return len(a), len(b), ";".join(groups), links


@pytest.mark.parametrize("chunk", [3, 1 << 15])
def test_groups_equal_plain_alignment(chunk, byte_model, piece_model):
    pair = alignment.Pair(bpe.vocabulary_path(), token_counts.vocabulary_path(), chunk)
    some = texts(1500, 2) + texts(200, 3, LETTERS + "▁") + ["x" * 400 + "é" * 300, "a" * 50 + "\n" * 9 + "b", "<|endoftext|> a"]
    found = pair.texts([" " + t for t in some])
    for t, (groups, links, n, ok) in zip(some, found):
        want = plain_alignment(t, byte_model, piece_model)
        assert ok == (want is not None), t
        if ok:
            assert (n >> 32, n & 0xFFFFFFFF, groups.decode(), len(links) // 8) == (*want[:3], len(want[3])), t


def test_fragments_compose_in_any_tree(byte_model, piece_model):
    pair = alignment.Pair(bpe.vocabulary_path(), token_counts.vocabulary_path(), 2)
    text = " " + "".join(texts(12, 4))
    a, b = byte_model.encode(text, add_special_tokens=False).ids, piece_model.encode(text[1:])
    parts, rng = pair.ranges(a, b), random.Random(5)
    want = pair.closed(pair.tree(parts))
    assert want[0].decode() == plain_alignment(text[1:], byte_model, piece_model)[2] and not all(p.cut for p in parts)
    for _ in range(20):
        rest = list(parts)
        while len(rest) > 1:
            k = rng.randrange(len(rest) - 1)
            rest[k:k + 2] = [pair.join(rest[k], rest[k + 1])]
        assert pair.closed(rest[0]) == want


@pytest.mark.parametrize("counted", [0, 1_000_000])
def test_alignment_of_documents(spark, docs, none, byte_model, piece_model, counted):
    paths = bpe.vocabulary_path(), token_counts.vocabulary_path()
    extra = spark.createDataFrame([(20, "ab▁c d"), (21, "y" * 900), (22, "no blank▁ but " * 60)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    # Long texts go through pieces, small ranges and several rounds.
    found = alignment.align_documents(docs, *paths, chunk=64, long_bytes=300, piece=32, fan=2, counted=counted)
    rows = [(r["doc_id"], plain_alignment(r["text"], byte_model, piece_model)) for r in docs.collect()]
    count = Counter(link for _, w in rows if w for link in w[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = []
    for doc, w in rows:
        n_a, n_b, groups, links = w or (0, 0, "", [])
        want.append((doc, n_a, n_b, len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                     hashlib.sha256(groups.encode()).hexdigest() if w else ""))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    if counted:
        assert alignment.align_documents(none, *paths).count() == 0


# Phrases --------------------------------------------------------------------------------------------------------------

def plain_phrases(rows, least, top, inside):
    f, n = Counter(), Counter()
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in (1, 2, 3):
                f.update((lang or "und", tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    out = defaultdict(list)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in candidates.items():
        if any(100 * b >= inside * a for (g, x), b in candidates.items() if g == lang and len(x) > len(w) and w in (x[:2], x[1:])):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), a, x, y, n[lang], -s) for lang, rows in out.items() for r, (s, _, p, a, x, y) in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize("range_words, fan, shard", [(1 << 21, 256, 1 << 20), (7, 2, 64)])
def test_collocations_equal_plain_counts(spark, monkeypatch, range_words, fan, shard):
    rng = random.Random(6)
    words = ["the", "The", "sea", "éa", "wide", "x\x00", "of", "a\x1cb", "𝔘"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", "\n", "\t"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None])) for _ in range(120)]
    rows += [(None, "en"), ("", "fr"), ("the sea " * 90, "en"), ("the sea " * 90, "en"), ("...", None)]
    for name, value in (("FAN", fan), ("SHARD_WORDS", shard)):
        monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS n", "2 AS shard", "'p' AS phrase").repartition(3)
    found = phrases.collocations(docs, least=4, top=40, inside=50, range_words=range_words)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, 4, 40, 50)


def test_collocations_of_nothing(none, docs):
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(docs.where("text IS NULL")).count() == 0


def test_transducers_keep_and_sum_counts():
    rng = random.Random(7)

    def some():
        return Counter(tuple(rng.choice(["b", "a", "cc"]) for _ in range(rng.randint(1, 3))) for _ in range(60))

    def plain(parts):
        # A path's weight holds all that pass it.
        out = Counter()
        for p in parts:
            for key, n in p.items():
                for k in range(1, len(key) + 1):
                    out[key[:k]] += n
        return {" ".join(k).encode(): n for k, n in out.items()}

    made = [some() for _ in range(5)]
    automata = [phrases.of_phrases([" ".join(k) for k in p], p.values())[0] for p in made]
    total = phrases.union([phrases.Transducer.load(a.dump()) for a in automata])
    for whole in (total, phrases.Transducer.load(total.share().dump())):
        assert phrases.compose(whole, whole) == plain(made)
    asked = phrases.of_phrases(["a b", "zz", "a zz b", "cc cc cc"], [1] * 4)[0]
    assert phrases.compose(asked, total) == {k: n for k, n in plain(made).items() if k in (b"a", b"a b", b"cc", b"cc cc", b"cc cc cc")}
    rows, n = total.paths()
    assert {tuple(total.words[i].decode() for i in r if i >= 0): m for r, m in zip(rows.tolist(), n.tolist())} == sum(made, Counter())


def test_scores_are_exact(spark):
    a, x, y = 123_456_789_012_345, 223_456_789_012_347, 323_456_789_012_349
    row = spark.createDataFrame([(a, x, y)], "a long, x long, y long").select(phrases.cut_score(F.col("a"), F.col("x"), F.col("y")).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (x * y)
