"""MinHash near-dedup and substring removal against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from sparkseries.llm import minhash_dedup, substring_dedup
from sparkseries.llm._state import connected_components


def words(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def shingles(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent):
    sets, top = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    top[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, sets


def corpus(seed, n=120):
    r = random.Random(seed)
    base = [[r.choice("abcdefgh") + str(r.randrange(60)) for _ in range(r.randrange(3, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(1000))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 85), (2, 5, 80)])
def test_components(docs, seed, k, percent):
    rows = corpus(seed)
    want, sets = brute_components(rows, k, percent)
    got = {r.rid: r for r in minhash_dedup.near_duplicates(docs(rows), shingle=k, percent=percent).collect()}
    assert {i: g.component_id for i, g in got.items()} == want
    assert all(g.n_shingles == len(sets[i]) and g.kept == (want[i] == i) for i, g in got.items())


def test_blocks_of_a_large_group(docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "LOT_ROWS", 8)
    rows = [(i, " ".join(f"c{j}" for j in range(60)) + f" x{i}") for i in range(50)] + [(i, " ".join(f"d{j}" for j in range(40))) for i in range(50, 60)]
    got = {r.rid: r.component_id for r in minhash_dedup.near_duplicates(docs(rows)).collect()}
    assert got == {i: 0 if i < 50 else 50 for i in range(60)}


def test_chained_boilerplate_grows_in_proportion(docs, spark):
    """Texts that share boilerplate meet in buckets without being links: pairs beyond the signature distance are dropped."""
    made = {}
    for n in (100, 200):
        r = random.Random(n)
        rows = [(i, " ".join([f"b{j}" for j in range(60)] + [f"u{i}_{r.randrange(10**6)}" for _ in range(60)])) for i in range(n)]
        assert all(g.kept for g in minhash_dedup.near_duplicates(docs(rows)).collect())
        nodes = minhash_dedup.sketch(docs(rows), "doc_id", "text", 5, 60).select("node", "sig")
        keyed = minhash_dedup.bucket_keys(nodes, 12, 5, 1)
        low = keyed.groupBy("key").agg({"node": "min"}).withColumnRenamed("min(node)", "hub")
        pairs = keyed.join(low, "key").where("node <> hub").selectExpr("node as u", "hub as v").distinct()
        made[n] = (pairs.count(), minhash_dedup.within(pairs, nodes, 60, minhash_dedup.reach_for(0.8, 60)).count())
    assert made[200][0] <= 8 * made[100][0] and made[200][1] <= 0.02 * made[200][0] + 2


def test_links_beyond_the_smallest_member(docs, monkeypatch):
    """A chain in which most members are no link of the bucket's smallest one: later rounds must find the rest."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    base = [f"w{j}" for j in range(100)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(2 * i, 2 * i + 24):
            w[j % 100] = f"x{j % 100}_{i // 4}"
        rows.append((i, " ".join(w)))
    want, _ = brute_components(rows, 3, 60)
    got = {g.rid: g.component_id for g in minhash_dedup.near_duplicates(docs(rows), shingle=3, percent=60).collect()}
    assert got == want and 1 < len(set(want.values())) < 40


def test_names_do_not_clash(docs):
    df = docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand here now ok")])
    for n in ("own_th", "kept_rid", "kept_th", "_th", "rid", "th", "cluster"):
        df = df.withColumn(n, docs([(1, "")]).select("key").first()[0] and minhash_dedup.F.lit("own"))
    got = minhash_dedup.deduplicate(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and {r.own_th for r in got} == {r._th for r in got} == {"own"}


def test_odd_rows(odd):
    got = minhash_dedup.near_duplicates(odd, shingle=3, percent=85).collect()
    assert len(got) == 10
    by = {r.rid: r for r in got if r.rid is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[4].n_shingles == 1
    assert by[6].component_id == 5 and not by[6].kept and all(by[i].kept for i in (1, 2, 3, 4, 5, 7))
    kept = minhash_dedup.deduplicate(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in (1, 2, 3, 4, 5, 7)] + [(True, 0), (True, 0)]
    assert kept[0].asDict().keys() == odd.first().asDict().keys()
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0 and minhash_dedup.deduplicate(odd.limit(0)).count() == 0


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(3, 3)]
    top = {}

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: root(i) for i in linked}


def brute_removed(rows, window):
    seen, split = Counter(), [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        seen.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_spans(docs, seed):
    r = random.Random(seed)
    passages = [[f"p{k}_{j}" for j in range(r.choice([34, 35, 36, 50, 90]))] for k in range(6)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(r.randrange(1, 6)):
            w += r.choice(passages) if r.random() < 0.5 else [f"u{i}_{r.randrange(40)}" for _ in range(r.randrange(1, 60))]
        rows.append((i, " ".join(w)))
    rows += [(90, "same " * 200), (91, "Same " * 34), (92, None), (93, "")]
    got = sorted(((g.rid, g.n_words, g.n_removed, g.kept_text) for g in substring_dedup.parse(docs(rows)).collect()), key=repr)
    assert got == brute_removed(rows, 35)


def test_factors_point_at_equal_words(docs):
    p = [f"q{j}" for j in range(80)]
    rows = [(1, " ".join(["a"] + p)), (2, " ".join(["b", "c"] + p[10:] + ["d"]))]
    got = {g.rid: g for g in substring_dedup.parse(docs(rows)).collect()}
    text = {i: t.split() for i, t in rows}
    for g in got.values():
        for f in g.factors:
            assert f.words >= 35 and text[g.rid][f.start : f.start + f.words] == text[f.ref_id][f.ref_start : f.ref_start + f.words]
    assert [(f.start, f.words) for f in got[2].factors] == [(2, 70)]


def test_one_id_with_different_texts(docs):
    p = [f"q{j}" for j in range(60)]
    rows = [(1, " ".join(["a"] * 3 + p)), (1, " ".join(["b"] * 40 + p[5:] + ["c"])), (1, " ".join(p[:40])), (2, " ".join(p[20:] + p[:10]))]
    got = sorted(((g.rid, g.n_words, g.n_removed, g.kept_text) for g in substring_dedup.parse(docs(rows)).collect()), key=repr)
    assert got == brute_removed(rows, 35)


def test_odd_texts(odd):
    got = substring_dedup.parse(odd).collect()
    assert len(got) == 10
    long = [g for g in got if g.rid in (5, 6)]
    assert [g.n_removed for g in long] == [30_000] * 3 and {g.kept_text for g in long} == {"", "tail"}
    assert substring_dedup.parse(odd.limit(0)).count() == 0
