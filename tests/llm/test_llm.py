"""Each operator against a brute-force version on a small table, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from signaldesk.llm import bpe, chat_tools, decontam, licenses, quality_model, quality_rules, shards, simhash, toxicity, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_are_balanced_gapless_and_keep_equal_texts_together(spark, docs, none):
    rows = [(i, f"text {i % 700} " + "y" * (i * 37 % 200)) for i in range(3000)] + [(10_000 + i, "hot copy") for i in range(1500)] + [(None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    got = shards.assign_shards(df).toPandas()
    assert len(got) == len(rows)
    total, mean = got.groupby("shard")["size"].sum(), got["size"].sum() / 8
    assert (abs(total - mean) <= 2 * 0.002 * mean + 300).all()
    for _, s in got.groupby("shard")["slot"]:
        assert sorted(s) == list(range(len(s)))
    by_key = got.sort_values("key")["shard"].to_numpy()
    assert (np.diff(by_key) >= 0).all()
    want = Counter(zlib.crc32(t.encode()) if t else 0 for _, t in rows)
    assert Counter(got["text_crc32"]) == want
    assert shards.assign_shards(none).count() == 0


def base_counts(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i:i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_match_brute_force(docs, none):
    got = quality_rules.judge(docs).select("row.doc_id", "row.text", *quality_rules.MEASURES).toPandas()
    for r in got.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    clean = quality_rules.clean_documents(docs)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 1, 4, 4, 5]
    assert quality_rules.clean_documents(none).count() == 0


def test_lines_lose_navigation_boilerplate_and_symbols(spark):
    body = "\n".join(f"Sentence number {i} tells of a place with its own story." for i in range(12))
    bad = "Home\nLog in\nHome | News | Sports | More | Help\n### $$$ ### &&& ***\nWe use cookies, accept cookies or read our privacy policy."
    df = spark.createDataFrame([(1, f"{bad}\n{body}"), (2, f"{body}\n" + bad * 5)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).select("row.doc_id", "clean_text", "kept", "n_good_lines").collect()}
    assert got[1]["clean_text"] == body and got[1]["n_good_lines"] == 12


def test_toxicity_learns_words_and_stems_and_spares_held_out_labels(spark, docs, none):
    rng = np.random.default_rng(1)
    plain, foul = [f"w{i}" for i in range(300)], ["scumbag", "rotbrain"] + [f"vile{e}" for e in ("ly", "ness", "st", "r")]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = list(rng.choice(plain, 90))
        if toxic:
            for k in rng.choice(90, 5, replace=False):
                words[k] = rng.choice(foul)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score_", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    net, prior = toxicity.fit(df, lab)
    got = toxicity.with_score(df, net, prior).withColumn("held", toxicity.held_out(F.col("doc_id"))).toPandas().merge(pd.DataFrame(labels, columns=["doc_id", "toxic"]))
    held = got[got["held"]]
    assert ((held["score"] >= 0.5) == (held["toxic"] == 1)).mean() > 0.9
    assert list(got["held"]) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]
    odd = toxicity.with_score(docs, net, prior, "p")
    assert odd.count() == docs.count() and odd.where("p IS NULL OR p < 0 OR p > 1").count() == 0
    assert toxicity.fit(none, lab.limit(0)) == (None, 0.0)
    assert toxicity.drop_toxic(none, lab).columns == docs.columns


def test_toxicity_gradients_match_differences():
    s = toxicity.Settings(window=5, hidden=3, embed=3, attention=2, buckets=64)
    net, rng = toxicity.Network(s), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, grams, owners = toxicity.Features(s).of(["", "alpha", "beta", "gamma"])
    index = rng.integers(0, 4, (5, 6))
    pad = np.zeros((5, 6), bool)
    pad[3:, 2] = True

    def loss():
        return net.forward(net.project(net.inputs(words, grams, owners).astype(np.float64)), index, pad)[0].sum()

    x = net.inputs(words, grams, owners)
    _, memo = net.forward(net.project(x), index, pad, keep=True)
    g, dx = net.gradients(x, index, pad, memo, np.ones(6))
    net.spread(g, dx, words, grams, owners)
    for name in ("uf", "wb", "cf", "att", "att_v", "out", "char"):
        at = np.unravel_index(np.argmax(abs(g[name])), g[name].shape)
        keep, eps = net.p[name][at], 1e-2
        net.p[name][at] = keep + eps
        up = loss()
        net.p[name][at] = keep - eps
        down = loss()
        net.p[name][at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(g[name][at], rel=0.03, abs=1e-3), name


def test_bpe_equals_the_tokenizers_library(docs, none):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    lib = Tokenizer.from_file(path)
    got = bpe.token_digests(docs, path).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got.itertuples():
        text = texts[None if pd.isna(r.doc_id) else r.doc_id]
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in docs.collect())
    assert bpe.token_digests(none, path).count() == 0
    merges = bpe.load(path)
    for word in (b"aaaaaaa", b"abababab" * 60, "ééé".encode() * 150):  # rounds and heap agree
        assert np.frombuffer(merges.encode_words([word])[0], "<u4").tolist() == merges._heap(word)


def test_quality_classifier_parts_clean_from_junk(spark, docs, none):
    rng = np.random.default_rng(2)
    vocab = [f"{a}{b}" for a in ("ler", "mon", "tas", "vil", "gor", "sin") for b in ("a", "en", "is", "or", "um", "ath", "ick")]
    rows = []
    for i in range(300):
        said = ". ".join(" ".join(rng.choice(vocab, 9)) for _ in range(8)) + ".\n" + " ".join(rng.choice(vocab, 12)) + "."
        rows.append((i, " ".join(w + "###" for w in said.split()) if i % 6 == 0 else said))
    got = quality_model.with_quality(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert ((got["score"] >= 0.5) == (got["doc_id"] % 6 != 0)).mean() > 0.98
    assert quality_model.with_quality(docs, "s_", "p_").where("s_ BETWEEN 0 AND 1 AND p_ BETWEEN 0 AND 1").count() == docs.count()
    assert quality_model.with_quality(none, "s_", "p_").count() == 0


def test_url_rules_and_rare_tokens(spark):
    urls = ["https://www.Example.com/en/1?x", "http://a.example.com/en/", "http://b.net/fr/2#t", "http://b.net", "http://notexample.com/en/", "http://x.org/casino.html",
            "http://x.org/casinos", "http://x.org/a?utm_source=feed", None, "", "no scheme", "ftp://x.org/wp-admin/", "http://x.org/wp-admin/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filters.judge_urls(df).collect()}
    assert [got[i]["rule"] for i in range(6)] == ["www.example.com/en/", "example.com/en/", "net/fr/", None, "com/", None]
    assert (got[0]["host"], got[0]["path"], got[3]["path"]) == ("www.example.com", "/en/1", "")
    assert [got[i]["verdict"] for i in range(13)] == ["allow", "block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block", "block"]
    index = url_filters.rarest_tokens(df, url_filters.PATTERN_RULES)
    plain = [any(r.verdict == "block" and re.search(r.pattern, (u or "").lower()) for r in url_filters.PATTERN_RULES) for u in urls]
    assert [got[i]["verdict"] == "block" for i in range(13) if not got[i]["rule"]] == [p for i, p in enumerate(plain) if not got[i]["rule"]]
    assert sum(map(len, index.values())) == len(url_filters.PATTERN_RULES)
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def brute_print(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k:k + size]) for k in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_components_match_brute_force(spark, docs, none):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"t{k}" for k in range(50)], 400)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(150):
        w = base[i % 25].split()
        w[int(rng.integers(len(w)))] = "other"
        rows.append((100 + i, " ".join(w)))
    rows += [(r["doc_id"], r["text"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.group_documents(df, (3,), simhash.Link(2), ["doc_id"], "doc_id").toPandas()
    prints = [brute_print(t, 3) for _, t in rows]
    assert Counter(int(x) & (2 ** 64 - 1) for x in got["fp0"]) == Counter(prints)
    distinct = sorted(set(prints))
    label = dict(zip(distinct, distinct))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root(p)] = min(least.get(root(p), i), i)
    for fp, c in zip(got["fp0"], got["component"]):
        assert c == least[root(int(fp) & (2 ** 64 - 1))]
    assert simhash.group_documents(none, (3,), simhash.Link(2), ["doc_id"], "doc_id").count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2 ** 63, 3000).astype(np.uint64)
    fps = np.concatenate([fps, fps[:800] ^ (np.uint64(1) << rng.integers(0, 63, 800).astype(np.uint64))])
    tree = simhash.build_tree(fps[:1000], 40, 2)
    assert tree.leaves > 8
    home, seen = {}, {}
    for leaf, at, own in tree.walk(fps, 2):
        for i, h in zip(at, own):
            seen.setdefault(int(i), set()).add(leaf)
            if h:
                home[int(i)] = leaf
    assert len(home) == len(fps)
    for i in range(800):
        assert home[3000 + i] in seen[i] and home[i] in seen[3000 + i]


def test_one_near_copy_stays(docs, none):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6, 7, 8, 9]
    assert simhash.drop_near_copies(none).count() == 0


def test_near_copies_match_brute_force_jaccard(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows = []
    for i, n in enumerate([50, 60, 80, 120, 200, 400] * 12):
        own = [str(w) for w in rng.choice(vocabulary, n)]
        rows.append((10 * i, " ".join(own)))
        for k in range(1, 4):  # edited copies on both sides of the bound
            w = list(own)
            for at in rng.choice(n, max(1, n * k // 75), replace=False):
                w[at] = f"new{rng.integers(10 ** 6)}"
            rows.append((10 * i + k, " ".join(w)))
        rows.append((10 * i + 4, " ".join(own + own[:n * 3 // 10])))  # repeats a passage of its own
    rows += [(9000 + i, "one very common passage that stands in many texts " * 3 + " ".join(rng.choice(vocabulary, 60))) for i in range(40)]
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    want = sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_near_copies_are_found_by_fingerprints(spark):
    """Without any band, texts whose fingerprints are equal or two bits apart are joined, if their shingles are alike."""
    rng = np.random.default_rng(5)
    own, printed = [f"v{k}" for k in rng.choice(3000, 900)], lambda t: simhash.fingerprint(simhash.words_of(t.encode()), 3)
    apart = lambda t: bin((printed(t) ^ printed(" ".join(own))) & (2 ** 64 - 1)).count("1")
    edited = next(t for i in range(900) if apart(t := " ".join([*own[:i], "new", *own[i + 1:]])) in (1, 2))
    texts = [" ".join(own), edited, " ".join(f"v{k}" for k in rng.choice(3000, 900))]
    prints = [printed(t) for t in texts]
    prints.append(prints[0])  # a text of the same fingerprint that is not alike
    texts.append("something else altogether is written here")
    df = spark.createDataFrame([(i, 900, [], p, t) for i, (p, t) in enumerate(zip(prints, texts))], "node long, n long, bands array<long>, fp0 long, text string")
    nodes = simhash.staged(df.drop("text"), "nodes")
    stars = simhash.similar_components(nodes, df.selectExpr("node", "cast(text as binary) text"))
    assert sorted(map(tuple, stars.collect())) == [(1, 0)]


def test_near_copies_of_one_text_are_not_checked_against_each_other(spark, monkeypatch):
    """Copies that share bands but are like few others: pairs checked grow with the copies, and the result is that of all pairs."""
    rng = np.random.default_rng(4)
    own, texts = [f"v{k}" for k in rng.choice(3000, 150)], []
    for i in range(240):
        w = list(own)
        for at in rng.choice(150, 1 + i % 10, replace=False):
            w[at] = f"new{rng.integers(10 ** 6)}"
        texts.append(" ".join(w))
    sets = [simhash.shingles_of(t.encode()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    checked, plain = [], simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda pairs, texts: (checked.append(pairs.count()), plain(pairs, texts))[1])
    got = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label)) and 100 < len(set(label)) < 200
    assert sum(checked) < 20 * len(texts)


def test_tool_calls_link_and_order(spark):
    call = ('{"tool_calls":[{"id":"b","name":"search","arguments":{"query":"x","limit":"ten"},"after":["a"]},'
            '{"id":"a","name":"calculate","arguments":{"expression":"1\\n\\"2"},"after":["gone"]},{"id":"p","name":"zip","arguments":{},"after":["q"]},{"id":"q","name":"search","arguments":{},"after":["p"]}]}')
    rows = [(1, 0, "assistant", call), (1, 1, "tool", '{"tool_call_id":"a","content":"3"}'), (1, 2, "tool", '{"tool_call_id":"a","content":"4"}'), (1, 3, "tool", '{"tool_call_id":"z","content":null}'),
            (1, 4, "user", None), (1, 5, "assistant", "plain {"), (None, 6, "assistant", '{"tool_calls":[{"id":"a","name":null}]}'), (2, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    got = {(r["conv_id"], r["turn"], r["place"]): r for r in chat_tools.link_tools(df).collect()}
    assert len(got) == 11
    b, a, p, q = (got[1, 0, k] for k in range(4))
    assert (a["level"], a["status"], a["fault"], a["json"]) == (0, "linked", None, '{"arguments":{"expression":"1\\n\\"2"},"id":"a","name":"calculate"}')
    assert (b["level"], b["status"], b["fault"]) == (1, "open", "limit is no integer") and b["json"].startswith('{"arguments":{"limit":"ten","query":"x"}')
    assert (p["level"], p["fault"], q["level"], q["fault"]) == (-1, "unknown tool", -1, "missing query")
    assert [got[1, t, 0]["status"] for t in (1, 2, 3)] == ["linked", "repeated", "orphan"]
    assert got[1, 4, 0]["json"] == '{"content":"","role":"user"}' and got[None, 6, 0]["fault"] == "no name"
    assert chat_tools.link_tools(df.limit(0)).count() == 0


def test_derived_calls_form_one_chain_with_flaws(spark):
    talk = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"text {c} {t}") for c in range(12) for t in range(20)], "conv_id long, turn long, role string, text string")
    got = chat_tools.link_tools(chat_tools.as_tool_traffic(talk)).toPandas()
    calls = got[(got["kind"] == "call") & (got["status"] != "repeated")]
    for r in calls.itertuples():
        t = int(r.id[1:])
        assert r.level == {"s": t - 1, "r": t}.get(r.id[0], -1)
    assert set(got["status"]) == {"plain", "linked", "repeated", "open", "orphan"}
    assert "words is no integer" in set(calls["fault"]) and (calls["level"] == -1).any()


def test_levels_match_brute_force_in_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    after = {(1, f"c{i}"): [f"c{i - 1}"] if i else [] for i in range(200)}
    after |= {(2, f"c{i}"): [f"c{k}" for k in sorted({int(k) for k in rng.integers(0, i, min(i, 2))})] + ["gone"] for i in range(60)}
    after |= {(3, "a"): ["c"], (3, "b"): ["a"], (3, "c"): ["b"], (3, "d"): ["c", "e"], (3, "e"): [], (3, "f"): ["f"], (3, "g"): ["e", "e"]}
    want = {}
    while True:
        new = {k: 1 + max((want[k[0], b] for b in v if (k[0], b) in after), default=-1) for k, v in after.items() if k not in want and all((k[0], b) in want for b in v if (k[0], b) in after)}
        if not new:
            break
        want |= new
    rounds = []
    monkeypatch.setattr(chat_tools, "staged", lambda df, label, real=chat_tools.staged: rounds.append(label) or real(df, label))
    df = spark.createDataFrame([(*k, v) for k, v in after.items()], "conv_id long, id string, after array<string>")
    got = {(r["conv_id"], r["id"]): r["level"] for r in chat_tools.levels(df).collect()}
    assert got == {k: want.get(k, -1) for k in after}
    assert len(rounds) <= 100


def test_decontamination_finds_verbatim_and_paraphrased_passages(spark, docs, none):
    rng = np.random.default_rng(5)
    common, rare = [f"c{k}" for k in range(40)], [f"r{k}" for k in range(4000)]

    def prose(n):
        return [str(rng.choice(common)) if rng.random() < 0.5 else str(rng.choice(rare)) for _ in range(n)]

    items = [(i, " ".join(prose(30)) + ". The answer is " + " ".join(prose(4)) + ".") for i in range(20)] + [(99, None), (98, "")]
    rows, truth = [], set()
    for d in range(200):
        words = prose(300)
        if d % 10 == 0:
            own = items[d % 20][1].replace(".", "").split()
            if d % 20 == 0:  # a fifth of the words changed, the answer kept
                own = [str(rng.choice(rare)) if k % 5 == 0 and k < 28 else w for k, w in enumerate(own)]
            words[100:100] = own
            truth.add((d, items[d % 20][0]))
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and not got - truth
    kept = decontam.drop_leaks(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(200)) - {d for d, _ in got} and kept.columns == df.columns
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, bench).count() == docs.count()


def test_licenses_match_brute_force(docs, none):
    got = licenses.scan_licenses(docs).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.itertuples():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[None if pd.isna(r.doc_id) else r.doc_id] or "")
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [i for p in licenses.BASE_PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and 0 <= r.score <= 1
        assert (None if pd.isna(r.first_word) else r.first_word) == min(places, default=None)
    r = got[got["doc_id"] == 8].iloc[0]
    assert (r["base_labels"], r["labels"], r["n_base"], r["share_alike"]) == ("mit", "bsd,gpl,mit", 2, False)
    assert licenses.scan_licenses(none).count() == 0


def test_license_expressions():
    assert licenses.to_postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.to_postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    for bad in ([], ["a", "b"], ["(", "a"], ["a", ")"], ["and"], ["a", "or"]):
        assert licenses.to_postfix(bad) is None
    assert licenses.evaluate(["gpl-3.0", "mit", "or"]) == ({"gpl", "mit"}, False)
    assert licenses.evaluate(["gpl-3.0", "mit", "and"]) == ({"gpl", "mit"}, True)
