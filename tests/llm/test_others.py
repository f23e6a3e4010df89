"""The other operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.llm import decontaminate, language_id, mixing, quality, sharding, topk, toxicity, warc
from sparkseries.llm import queries as Q

SF = "/root/testdata/sf0.001"


# --- SQL --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    found = c.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(n)] for n in df.columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want and want


# --- language id ------------------------------------------------------------------------------------


def test_language_held_out_and_odd(spark, odd):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(d.where("doc_id % 2 = 0"))
    got = language_id.predict(d.where("doc_id % 2 = 1"), model).join(d, F.col("rid") == F.col("doc_id"))
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.rid in (1, 2, 3)} == {"und"}
    none = language_id.fit(d.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(odd.limit(0), model).count() == 0


def test_backoff_by_hand(docs, spark):
    train = spark.createDataFrame([("aa", "abc abc abd"), ("bb", "xyz xyw")], "lang string, text string")
    model = language_id.fit(train)
    got = {r.rid: r.lang_pred for r in language_id.predict(docs([(1, "ABC"), (2, "abx"), (3, "qxyq"), (4, "漢"), (5, "— « 12")]), model).collect()}
    assert got == {1: "aa", 2: "aa", 3: "bb", 4: "aa", 5: "und"}


def brute_language(train, texts, order=5):
    words, grams = {}, {}
    for lang, text in train:
        for w in text.split():
            words.setdefault(w, {}).setdefault(lang, 0)
            words[w][lang] += 1
            p = f" {w} "
            for n in range(1, order + 1):
                for g in (p[i : i + n] for i in range(len(p) - n + 1)):
                    if g.strip():
                        grams.setdefault((n, g), {}).setdefault(lang, 0)
                        grams[n, g][lang] += 1
    langs = sorted({lang for lang, _ in train})

    def logs(counts):
        total = {x: sum(c.get(x, 0) for c in counts.values()) for x in langs}
        low = min(math.log(n / total[x]) for c in counts.values() for x, n in c.items()) - 2
        return {e: np.array([math.log(c[x] / total[x]) if x in c else low for x in langs]) for e, c in counts.items()}

    word, gram = logs(words), {n: logs({g: c for (m, g), c in grams.items() if m == n}) for n in range(1, order + 1)}

    def score(w):
        p = f" {w} "
        own = ([gram[n][p[i : i + n]] for i in range(len(p) - n + 1) if p[i : i + n] in gram[n]] for n in range(order, 0, -1))
        return word[w] if w in word else next((np.mean(x, axis=0) for x in own if x), None)

    out = {}
    for i, text in texts:
        known = [x for x in map(score, text.split()) if x is not None]
        mean = np.mean(known, axis=0) if known else np.zeros(len(langs))
        best = int(np.argmax(np.round(mean, 9)))
        out[i] = (langs[best], 1 / np.exp(4 * (mean - mean[best])).sum())
    return out


@pytest.mark.parametrize("sizes", [{}, {"head_words": 40, "part_grams": 300}])
def test_language_brute_force(docs, spark, sizes):
    r = random.Random(5)
    make = lambda letters: "".join(r.choice(letters) for _ in range(r.randrange(1, 8)))
    common = [(lang, " ".join(make(letters) for _ in range(400))) for lang, letters in (("aa", "abcdé"), ("bb", "cdeéf"), ("cc", "efgß")) for _ in range(3)]
    texts = [(i, " ".join([make("abcdeéfgßxy漢") for _ in range(r.randrange(1, 9))] * r.randrange(1, 3))) for i in range(60)]
    model = language_id.fit(spark.createDataFrame(common, "lang string, text string"))
    want = brute_language(common, texts)
    got = {g.rid: (g.lang_pred, g.score) for g in language_id.predict(docs(texts), model, **sizes).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == x and math.isclose(got[i][1], s, rel_tol=1e-5) for i, (x, s) in want.items())


def test_language_keeps_rare_words(docs, spark):
    """Words beyond the 20,000 most frequent ones of a language count: they beat what their n-grams say."""
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    rare = [word(i) for i in range(22_000, 23_000)]  # once each in aa; their n-grams are far more frequent in bb
    train = [("aa", " ".join(f"{word(i)} {word(i)}" for i in range(22_000))), ("aa", " ".join(rare)), ("bb", " ".join(f"{w}k" for w in rare for _ in range(50)))]
    model = language_id.fit(spark.createDataFrame(train, "lang string, text string"))
    got = language_id.predict(docs([(i, w) for i, w in enumerate(rare)]), model).collect()
    assert len(got) == 1000 and {g.lang_pred for g in got} == {"aa"}


# --- classifiers ------------------------------------------------------------------------------------


def held_out(spark, name, label, sf="sf0.01"):
    found = Q.QUERIES[name](spark, f"/root/testdata/{sf}")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).collect()
    return np.array([r.score for r in rows]), np.array([r.predicted for r in rows]), np.array([r.y for r in rows])


def test_quality_held_out(spark):
    score, pred, y = held_out(spark, "op2_quality_rules", "quality")
    assert (pred == y).mean() > 0.95 and score[y == 1].mean() > score[y == 0].mean() + 0.5


def test_toxicity_held_out(spark):
    score, pred, y = held_out(spark, "op10_toxicity", "toxic")
    assert pred[y == 0].mean() < 0.05 and score[y == 1].mean() > score[y == 0].mean() + 0.3
    assert pred[y == 1].mean() >= 0.8  # 14 rows at this size


def test_toxicity_held_out_recall_of_the_larger_table(spark):
    score, pred, y = held_out(spark, "op10_toxicity", "toxic", "sf0.1")
    assert pred[y == 1].mean() >= 0.9 and y[pred == 1].mean() >= 0.85


def test_classifiers_on_odd_rows(spark, odd):
    stats = quality.statistics(odd)
    assert stats.count() == 10
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for m in (quality.fit(stats, labels.limit(0)), quality.fit(stats, labels.where("doc_id = 4"))):
        assert all(0 <= r.score <= 1 for r in quality.score(stats, m).collect())
    for t in (labels, labels.limit(0)):
        m = toxicity.fit(odd, t)
        rows = toxicity.score(odd, m).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.reject(odd, m, threshold=1.1).columns == odd.columns
    assert quality.statistics(odd.limit(0)).count() == 0


def brute_statistics(text):
    """The 18 statistics of a text, word by word."""
    raw = (text or "").encode()
    words = raw.split()
    n, mild = len(words), b".,;:'\"!?()-"
    if not n:
        return [0.0] * len(quality.STATISTICS)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c > 127
    symbol = lambda c: c > 8 and not letter(c) and not 48 <= c <= 57 and c not in b" \t\n\x0b\x0c\r"
    upper = lambda c: 65 <= c <= 90
    stops, lines = sum(w.endswith(b".") for w in words), raw.count(b"\n")
    grams = [tuple(words[i : i + 5]) for i in range(n - 4)]
    return [math.log1p(n), sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, sum(map(upper, raw)) / len(raw), sum(48 <= c <= 57 for c in raw) / len(raw), sum(symbol(c) and c not in mild for c in raw) / len(raw), sum(c > 127 for c in raw) / len(raw), stops / n,
            lines / n, n / (lines + 1), len(set(words)) / n, max(map(words.count, set(words))) / n, sum(a == b for a, b in zip(words, words[1:])) / n, (len(grams) - len(set(grams))) / n, sum(not any(map(letter, w)) for w in words) / n,
            sum(symbol(w[-1]) and w[-1] not in mild for w in words) / n, n / (stops + 1), sum(sum(map(letter, w)) > 1 and all(upper(c) for c in w if letter(c)) for w in words) / n]


def test_statistics_by_brute_force(spark, docs):
    r = random.Random(5)
    signs = ["THE", "the", "a.", "B2B", "12", "***", "don't", "é", "ÉÈ", "漢字", "antidisestablishment", "x|", "y#", "(z)", "-", "end.", "NASA", "a", "\x01"]
    texts = [None, "", " \n\t ", "one", "a a a a a a a", "...", "x " * 20_000 + "END."] + ["".join(r.choice(signs) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.randrange(1, 60))) for _ in range(80)]
    got = {g.rid: list(g)[1:] for g in quality.statistics(docs(list(enumerate(texts)))).collect()}
    short = [(i, t) for i, t in enumerate(texts) if len(t or "") < 5000]
    assert len(got) == len(texts) and all(np.allclose(got[i], brute_statistics(t), atol=1e-12) for i, t in short)
    assert got[6][10] == 2 / 20_001 and got[6][11] == 20_000 / 20_001


@pytest.mark.parametrize("texts,ones", [(["same text here"] * 2, 1), ([f"w{i} " * (i + 1) for i in range(12)], 9), (["tie one", "tie two"] * 30, 30)])
def test_quality_without_splits_is_the_share_of_label_1(spark, docs, texts, ones):
    """Too few rows for a split, equal texts, constant statistics."""
    stats = quality.statistics(docs(list(enumerate(texts))))
    labels = spark.createDataFrame([(i, int(i < ones)) for i in range(len(texts))], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    found = [r.score for r in quality.score(stats, model).collect()]
    assert len(found) == len(texts) and all(0 <= x <= 1 for x in found)
    if not model.rules:
        assert np.allclose(found, ones / len(texts))
    assert ones > 1 or not model.rules


def test_no_evidence_rejects_nothing(spark, docs):
    d = docs([(i, f"only {i} words") for i in range(12)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    assert model.entries == () and toxicity.reject(d, model).count() == 12
    assert toxicity.reject(d, toxicity.fit(d, labels.limit(0))).count() == 12


def test_rules_compile_to_their_conditions(spark):
    text = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 2 <= 0.25)\n    Predict: 0.0\n   Else (feature 2 > 0.25)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    a, c = quality.STATISTICS[0], quality.STATISTICS[2]
    assert quality.tree_rules(text) == [((a, "<=", 1.5),), ((a, "<=", 1.5), (c, "<=", 0.25)), ((a, "<=", 1.5), (c, ">", 0.25)), ((a, ">", 1.5),)]
    df = spark.createDataFrame([(1.0, 0.1), (1.0, 0.9), (2.0, 0.9)], f"{a} double, {c} double")
    assert [r[0] for r in df.select(quality.compile_rule(quality.tree_rules(text)[2])).collect()] == [False, True, False]


def test_a_stem_that_clean_texts_hold_once_counts_from_twice_on(spark, docs):
    """Two words in equally many toxic texts both count; a stem that many clean texts hold once needs more."""
    r = np.random.default_rng(8)
    plain = lambda: " ".join(r.choice(["alpha", "brick", "cloud", "delta", "ember"], 12))
    stem = lambda: " vex" + "".join(r.choice(list("bcdfghjk"), 4))
    rows, labels = [], []
    for i in range(600):
        kind = i % 6
        extra = {0: " zebrano", 1: " yonder", 2: "".join(stem() for _ in range(6)), 3: stem()}.get(kind, "")
        rows.append((i, plain() + extra))
        labels.append((i, int(kind < 3)))
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    new = docs([(0, plain() + " zebrano"), (1, plain() + " yonder"), (2, plain() + " vexnew vexother vexmore vexa vexb vexc"), (3, plain() + " vexnew"), (4, plain())])
    score = {x.rid: x.score for x in toxicity.score(new, model).collect()}
    assert min(score[0], score[1], score[2]) > 0.5 > max(score[3], score[4])


def test_lexicon_has_no_cap(spark, docs):
    """More entries than any small number, each in a few toxic texts that hold no other."""
    name = lambda k: "".join("bcdfghjklm"[int(c)] for c in f"{k:03d}")
    rows, labels = [], []
    for k in range(300):
        for j in range(4):
            rows.append((len(rows), f"plain words here {name(k)}zz{name(k)} and there x{j}"))
            labels.append((len(labels), 1))
    for j in range(3000):
        rows.append((len(rows), "plain words here and there " * 12 + f"x{j}"))
        labels.append((len(labels), 0))
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.entries) >= 300
    got = toxicity.score(docs([(k, f"plain {name(k)}zz{name(k)} words") for k in range(300)]), model)
    assert got.where("score >= 0.3").count() == 300


def coded(r, y, rates):
    """Codes of voters: rates[v] = (share that votes toxic among toxic rows, among clean rows)."""
    return np.stack([(r.random(len(y)) < np.where(y, a, b)).astype(np.int8) for a, b in rates], axis=1)


def test_label_model_finds_classes_without_labels_votes():
    r = np.random.default_rng(5)
    y = r.random(6000) < 0.2
    v = coded(r, y, [(0.7, 0.01), (0.6, 0.02), (0.8, 0.03), (0.5, 0.05), (0.4, 0.4)])
    v = np.concatenate([v, np.zeros((6000, toxicity.PATTERNS), np.int8)], axis=1)
    wrong = y.astype(int)
    flip = r.choice(6000, 300, replace=False)
    wrong[flip] = 1 - wrong[flip]
    for label, votes in ((np.full(6000, -1), True), (wrong, False), (wrong, True)):
        post = toxicity.label_model(v, np.ones(6000), label, label_votes=votes)
        assert ((post > 0.5) == y).mean() > 0.95


def test_label_model_counts_copies_of_a_voter_once():
    """Ten copies of one weak voter must not outvote two good ones; the tree ties them to each other."""
    r = np.random.default_rng(6)
    y = r.random(8000) < 0.3
    weak = coded(r, y, [(0.5, 0.3)])
    v = np.concatenate([coded(r, y, [(0.9, 0.05), (0.85, 0.05)]), np.repeat(weak, 10, axis=1)], axis=1)
    post = toxicity.label_model(v, np.ones(8000), y.astype(int), label_votes=False)
    best = toxicity.label_model(v[:, :3], np.ones(8000), y.astype(int), label_votes=False)
    assert np.abs(post - best).max() < 0.1 and ((post > 0.5) == y).mean() > 0.9
    joint = [toxicity._joint(v, np.where(y == c, 1.0, 0.0)) for c in (True, False)]
    parent = toxicity.correlation_tree(joint, 12)
    assert sum(parent[i] >= 2 and parent[i] != i for i in range(2, 12)) == 9


# --- sharding and mixing ----------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1, 60, 400, 10**9])
def test_shards_fit_and_split_only_if_needed(docs, limit):
    r = random.Random(1)
    rows = [(i, "x" * r.randrange(0, 50)) for i in range(200)]
    got = sharding.assign(docs(rows), limit).collect()
    size = {i: len(t) for i, t in rows}
    held = {}
    for g in got:
        held.setdefault(g.shard, []).append(g.doc_id)
    assert sorted(i for v in held.values() for i in v) == list(range(200))
    for shard, ids in held.items():
        assert sum(size[i] for i in ids) <= limit or len(ids) == 1
        assert all(g.shard_bytes == sum(size[i] for i in ids) for g in got if g.shard == shard)
    parents = {s[:-1] for s in held if s and "+" not in s}
    for p in parents:
        assert sum(size[i] for s, ids in held.items() if s.startswith(p) for i in ids) > limit


def test_hot_key_is_dealt_into_pieces(docs, odd):
    got = sharding.assign(docs([(7, "y" * 10)] * 100 + [(8, "z")]), 100).collect()
    assert len(got) == 101
    sums = {}
    for g in got:
        sums[g.shard] = sums.get(g.shard, 0) + len(g.text)
    assert max(sums.values()) <= 100 and len(sums) >= 11
    assert sharding.assign(odd, 1000).count() == 10 and sharding.assign(odd.limit(0), 10).count() == 0


def test_shard_names_do_not_clash_and_pieces_repeat(docs):
    names = ["d", "_bits", "bits", "bytes", "row", "cell4", "leaf", "shard_bytes", "lot", "at", "large", "key"]
    df = docs([(i % 5 or 7, "y" * 10) for i in range(60)] + [(None, None)])
    for n in names:
        df = df.withColumn(n, F.lit("own"))
    found = [sorted(tuple(r) for r in sharding.assign(df, 100).select("doc_id", "shard", "shard_bytes", "d", "_bits", "bits", "lot").collect() if r.doc_id) for _ in range(2)]
    assert len(found[0]) == 60 and found[0] == found[1] and {r[3:] for r in found[0]} == {("own",) * 4}


def test_mixing_names_do_not_clash(docs):
    df = docs([(i % 40, f"t{i % 40}") for i in range(80)])
    plain = sorted(tuple(r) for r in mixing.mix(df).select("doc_id", "copy", "mix_order").collect())
    for n in ("_key", "key", "_n", "n", "_u", "u", "_source", "own", "of", "_cdf", "cdf", "row", "copy"):
        df = df.withColumn(n, F.lit("own"))
    got = mixing.mix(df)
    assert sorted(tuple(r) for r in got.select("doc_id", "copy", "mix_order").collect()) == plain
    assert got.where("n = 'own' and key = 'own' and cdf = 'own' and _u = 'own'").count() == len(plain)
    counts = {}
    for i, c, _ in plain:
        counts.setdefault(i, []).append(c)
    assert all(c == sorted(list(range(len(c) // 2)) * 2) for c in counts.values())  # repeated rows have equal counts


def test_mixing_of_a_rare_source(spark):
    """A rate of thousands: counts stay Poisson and no array is built step by step."""
    d = spark.range(4001).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") == 0, "rare").otherwise("b").alias("source"))
    got = {r.source: r["count"] for r in mixing.mix(d, {"rare": 0.5, "b": 0.5}).groupBy("source").count().collect()}
    assert abs(got["rare"] - 2000) < 6 * 45 and abs(got["b"] - 2000) < 6 * 45


def test_write_shards(docs, spark, tmp_path):
    sharding.write_shards(docs([(i, "x" * 20) for i in range(40)]), f"file://{tmp_path}/s", 200)
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/s").count() == 40


def test_poisson_counts_by_brute_force(docs):
    rows = [(i, f"t{i}") for i in range(300)] + [(None, "n"), (None, None)]
    weights = {"s0": 3.0, "s1": 1.0}
    got = mixing.mix(docs(rows), weights, seed=5).collect()
    n = {s: sum(i is not None and i % 3 == int(s[1]) for i, _ in rows) for s in weights}
    counts = {}
    for g in got:
        counts[g.doc_id] = counts.get(g.doc_id, 0) + 1
    for i, t in rows:
        s = None if i is None else f"s{i % 3}"
        rate = weights.get(s, 0) / 4 * len(rows) / n[s] if s in weights else 0
        u = int(hashlib.md5(f"5|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52 if i is not None else 0
        k, total = 0, math.exp(-rate)
        while rate and total <= u:
            k += 1
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        assert counts.get(i, 0) == (k if rate else 0)
    assert mixing.mix(docs(rows).limit(0)).count() == 0


def test_mixing_meets_weights(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 8, "a").otherwise("b").alias("source"))
    got = {r.source: r["count"] for r in mixing.mix(d, {"a": 0.5, "b": 0.5}).groupBy("source").count().collect()}
    assert abs(got["a"] - 10_000) < 400 and abs(got["b"] - 10_000) < 400


# --- WARC -------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    r = random.Random(2)
    rows = [(i, r.choice([f"http://WWW.Host{i % 7}.example:80/p?{i % 3}#f", "https://a.b/x", None, "not a url", "http://[bad/"]), r.choice([None, "", "<p>é</p>", f"<b>{i % 5}</b>" * 50, f"own {i}"])) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    a = warc.write(pages, block_lines=16)
    got = {g.page_id: g for g in warc.digests(a, pages).collect()}
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), i)
    for i, u, h in rows:
        b, g, top = (h or "").encode(), got[i], last[h or ""]
        assert (g.payload_bytes, g.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (g.record_type, g.refers_to) == (("response", None) if i == top else ("revisit", top))
    bodies = {g.page_id: bytes(g.payload) for g in warc.read(a, pages.where("page_id < 50")).collect() if g.record_type == "response"}
    assert all(v == (rows[k][2] or "").encode() for k, v in bodies.items())
    assert warc.read(a, pages.withColumn("page_id", F.col("page_id") + 10_000)).count() == 0
    short = warc.digests(warc.write(pages, min_revisit_bytes=10), pages)
    assert short.where("record_type = 'revisit' and payload_bytes < 10").count() == 0
    assert warc.digests(warc.write(pages.limit(0)), pages.limit(0)).count() == 0


def test_warc_keeps_every_capture_of_a_key(spark):
    rows = [(1, "http://a.b/x", "one"), (1, "http://a.b/x", "two two"), (1, "https://A.b/x#f", "three"), (None, "http://a.b/x", "four"), (None, None, None)] + [(2, "http://a.b/y", f"hot {i % 50}") for i in range(200)] + [(3, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "part": F.lit(2), "file": F.lit("f")})
    a = warc.write(pages.repartition(4), block_lines=7)
    got = warc.read(a, pages).collect()
    assert len(got) == len(rows) and len(warc.read(a, pages.where("page_id = 2")).collect()) == 200
    assert sorted(bytes(g.payload).decode() for g in got if g.page_id == 1) == ["one", "three", "two two"]
    sizes = sorted((g.page_id or 0, g.payload_bytes) for g in warc.digests(a, pages).collect())
    assert sizes == sorted((i or 0, len(h or "")) for i, _, h in rows)
    assert [tuple(r) for r in warc.lookup(a, pages.where("html = 'three'")).select("page_id", "url").collect()] == [(1, "https://A.b/x#f")]


def test_surt():
    assert warc.surt("http://User@WWW.Example.com:80/a/b?c=1#d") == "com,example,www)/a/b?c=1"
    assert warc.surt("https://a.b:8443") == "b,a:8443)/" and warc.surt(None) == ")"


# --- decontamination --------------------------------------------------------------------------------


def brute_tiles(d, p, k):
    used_d, used_p, out = set(), set(), 0
    while True:
        best = None
        for i in range(len(d)):
            for j in range(len(p)):
                n = 0
                while i + n < len(d) and j + n < len(p) and d[i + n] == p[j + n] and i + n not in used_d and j + n not in used_p:
                    n += 1
                if n >= k and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return out
        n, i, j = best
        used_d.update(range(i, i + n))
        used_p.update(range(j, j + n))
        out += n


def test_tiling_by_brute_force(docs, spark):
    r = random.Random(3)
    items = [(k, " ".join(f"{r.choice('abcdef')}{r.randrange(9)}" for _ in range(r.randrange(4, 40)))) for k in range(12)]
    rows = []
    for i in range(60):
        p = r.choice(items)[1].split()
        cut = r.randrange(len(p))
        w = [f"u{r.randrange(99)}" for _ in range(10)] + (p[cut:] + p[:cut] if r.random() < 0.5 else p[: max(1, cut)]) + [f"v{r.randrange(99)}" for _ in range(5)]
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k): m for i, t in rows for k, x in items for m in [brute_tiles(t.lower().split(), x.lower().split(), 5)] if len(x.split()) >= 5 and m >= 0.6 * len(x.split())}
    for part in (2_000_000, 40):
        got = {(g.rid, g.item_id): g.matched_words for g in decontaminate.contaminated(docs(rows), bench, part_words=part).collect()}
        assert got == want and want
    clean = {g.doc_id for g in decontaminate.decontaminate(docs(rows), bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in want}


def test_one_seed_repeated_many_times(docs, spark, monkeypatch):
    """A seed that stands very often in a text and in every item: the same result in small lots of pairs."""
    bench = spark.createDataFrame([(k, "a " * 30 + f"tail{k} one{k} two{k} three{k} four{k}") for k in range(40)], "item_id long, text string")
    rows = [(i, "a " * (30 * i) + f"tail{i} one{i} two{i} three{i} four{i}") for i in range(8)] + [(9, None), (9, "a " * 5000)]
    want = sorted((g.rid, g.item_id, g.matched_words) for g in decontaminate.contaminated(docs(rows), bench).collect())
    assert (9, 0, 30) in want and (1, 1, 35) in want and (0, 0, 5) not in want
    monkeypatch.setattr(decontaminate, "PAIRS", 100)
    assert sorted((g.rid, g.item_id, g.matched_words) for g in decontaminate.contaminated(docs(rows), bench).collect()) == want


@pytest.mark.parametrize("kind,ids", [("int", [7, 8, None]), ("string", ["x", "é", None]), ("long", [1 << 40, 2, None]), ("date", [None, None, None])])
def test_item_ids_of_any_type(docs, spark, kind, ids):
    """Also repeated items: each repetition is reported, and held once."""
    texts = ["one two three four five six", "red green blue white black", "ten nine eight seven six five"]
    items = [(i, t) for i, t in zip(ids, texts)] + [(ids[0], texts[0])] * 3
    bench = spark.createDataFrame(items, f"item_id {kind}, text string")
    for part in (2_000_000, 6):
        got = decontaminate.contaminated(docs([(k, f"a {t} b") for k, t in enumerate(texts)] + [(9, "none of it")]), bench, part_words=part)
        assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType
        assert sorted((r.rid, r.item_id) for r in got.collect() if r.item_id is not None) == sorted((k, i) for k, i in ((0, ids[0]), (1, ids[1]), *[(0, ids[0])] * 3) if i is not None)
        assert got.where("item_id is null").count() == (6 if kind == "date" else 1)


def test_decontamination_odd(odd, spark):
    bench = spark.createDataFrame([(1, None), (2, "one two"), (3, "one two three four five six")], "item_id long, text string")
    assert [(g.rid, g.item_id) for g in decontaminate.contaminated(odd, bench).collect()] == [(None, 3)]
    assert decontaminate.decontaminate(odd, bench).count() == 9
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0 and decontaminate.decontaminate(odd.limit(0), bench).count() == 0


# --- top-k ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,n,d", [(0, 700, 5), (1, 40, 12), (2, 6, 3)])
def test_topk_brute_force(spark, seed, n, d):
    r = np.random.default_rng(seed)
    x = r.integers(-20, 20, (n, d))
    x[r.random(n) < 0.3] = x[0]  # repeated vectors tie
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [None] * d)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<bigint>")
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), k=10, block_rows=128, query_rows=16).collect()
    found = {(g.query_id, g["rank"]): (g.vec_id, g.score) for g in got}
    for q in range(0, n, 10):
        best = sorted(((-int(x[q] @ x[c]), c) for c in range(n) if c != q))[:10]
        assert [found[q, k + 1] for k in range(len(best))] == [(c, -s) for s, c in best]
    assert all(g.query_id < n and g.vec_id < n for g in got)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_large_integers(spark):
    df = spark.createDataFrame([(1, [900000001, 800000003]), (2, [900000007, 800000011]), (3, [-5, 7])], "vec_id long, vector array<bigint>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df).collect()}
    assert got[1, 1] == (2, 900000001 * 900000007 + 800000003 * 800000011) and got[1, 2] == (3, -5 * 900000001 + 7 * 800000003)
    wide = spark.createDataFrame([(1, [1 << 40, 3]), (2, [1 << 22, 5]), (3, [1 << 30, 0])], "vec_id long, vector array<bigint>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(wide, wide.where("vec_id = 2")).collect()}
    assert got == {(2, 1): (1, (1 << 62) + 15), (2, 2): (3, 1 << 52)}
    with pytest.raises(Exception, match="OverflowError"):
        topk.top_k(wide, wide).collect()


def test_topk_widths_repeats_and_names(spark):
    rows = [(1, [1, 2]), (1, [1, 2]), (2, [3, 4]), (3, []), (4, [5, 6, 7]), (5, [1, 1, 1]), (None, [9, 9]), (6, None), (7, [0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<bigint>").withColumns({"v": F.lit(0), "id": F.lit(1), "width": F.lit(2), "block": F.lit(3), "bound": F.lit(4)})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df, k=3).collect())
    assert got == [(1, 1, 2, 11), (1, 2, 7, 0), (2, 1, 1, 11), (2, 2, 1, 11), (2, 3, 7, 0), (4, 1, 5, 18), (5, 1, 4, 18), (7, 1, 1, 0), (7, 2, 1, 0), (7, 3, 2, 0)]


def test_topk_bound_spares_reads():
    """With a bound from elsewhere a block reads fewer vectors and loses nothing above the bound."""
    r = np.random.default_rng(3)
    x = np.round(r.standard_normal((4000, 3)) * 100).astype(np.int64)
    q = x[:40]
    ids = np.arange(4000)
    a, b, s, free = topk.search_block(x, ids, q, ids[:40], 5)
    kth = np.array([s[a == i].min() for i in range(40)])
    a2, b2, s2, bounded = topk.search_block(x, ids, q, ids[:40], 5, kth)
    assert (list(a), list(b), list(s)) == (list(a2), list(b2), list(s2)) and bounded.sum() <= free.sum() < 0.5 * 40 * 4000


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns = docs.columns
    toxic = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 0").collect()}
    kept = P.reject_toxic(spark, docs, "/root/testdata/sf0.01")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == columns and len(clean & ids) >= 0.98 * len(clean) and len(toxic & ids) <= 0.4 * len(toxic)
    small = spark.createDataFrame(kept.limit(300).collect(), kept.schema)
    alone = P.drop_near_duplicates(spark, small, SF)
    from test_dedup import brute_components

    want, _ = brute_components([(r.doc_id, r.text) for r in small.collect()], 5, 80)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(set(want.values())) and alone.columns == columns
    free = P.drop_benchmark(spark, alone, SF)
    mixed = P.mix_sources(spark, free, SF)
    assert free.columns == mixed.columns == columns
    last = P.shard(spark, mixed, SF)
    assert last.count() == mixed.count() and set(columns) < set(last.columns) and [n for n, _ in P.STAGES][0] == "toxicity"


def test_pipeline_rejects_what_op10_calls_toxic(spark, docs):
    even = toxicity.Model(((1, 1, 0, 0.1),), np.array([0, -0.4, 0, 0, 0, 0, 0, 0]))  # an entry that no text holds, 0.40 for every text
    assert toxicity.reject(docs([(1, "a b"), (2, None)]), even).count() == 0
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels.where(Q._remainder("doc_id", 4) != 2))
    held_out = {r.doc_id for r in labels.where("toxic = 1").where(Q._remainder("doc_id", 4) == 2).collect()}
    found = {r.doc_id for r in Q.op10_toxicity(spark, "/root/testdata/sf0.01").where("predicted = 1").collect()}
    kept = {r.doc_id for r in toxicity.reject(d, model).collect()}
    assert held_out and not kept & found and len(held_out - kept) == len(held_out & found) > 0  # the operator's own recall


def test_pipeline_runs_on_odd_tables(spark, tmp_path):
    """Nulls in every column, an id twice, empty and long texts, extra columns with clashing names, no labels, empty tables."""
    import corpus_pipeline as P

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id int, text string")
    rows = [(1, "a b c d e f", "en", "s", 3, "k", 1), (2, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 2), (None, "one two three four five six seven eight nine ten", "de", "t", 1, "y", 3), (5, "long " * 40_000 + "tail", "en", "s", 1, None, 4), (6, "漢字 É ß", None, "s", 9, "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, shard int")
    for name, d, lab, items in (("odd", docs, labels, bench), ("bare", docs, labels.limit(0), bench.limit(0)), ("none", docs.limit(0), labels, bench)):
        at = str(tmp_path / name)
        for table, df in (("documents", d), ("labels", lab), ("benchmark", items)):
            df.write.parquet(f"{at}/{table}.parquet")
        out = P.run(spark, at)
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert set(docs.columns) <= set(out.columns)
        assert not ids if name == "none" else ids <= {1, 2, 5, 6, None} if name == "odd" else ids <= {1, 2, None, 5, 6}


def test_pipeline_keeps_clean_documents(spark):
    """Before mixing, what is gone was toxic, a near copy or a benchmark passage."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, sf)
    out = P.run(spark, sf)
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} <= left and len(left) > 150
