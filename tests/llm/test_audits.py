"""Source divergence, quality rules on shared lines and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.llm import centroids, divergence, line_quality
from sparkseries.llm._words import slices

# --- source divergence ------------------------------------------------------------------------------


def brute_divergence(rows, min_docs, top):
    plain = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    terms = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain(text)))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in terms}:
        own = [(s, c) for x, s, c in terms if x == lang]
        docs = Counter(t for _, c in own for t in c)
        kept = sorted(t for t in docs if docs[t] >= min_docs)
        sources = sorted({s for s, _ in own})
        count = {s: {t: sum(c[t] for x, c in own if x == s) for t in kept} for s in sources}
        total = {t: sum(count[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        q = share(total)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            p = share(count[s])
            pairs = [(o, sum(gap(p[t], share(count[o])[t]) for t in kept)) for o in sources if o != s]
            best = [(t, gap(p[t], q[t])) for t in kept if count[s][t] > 0 and p[t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(found) if part == "pair" or r < top]
    return sorted(out)


def corpus(spark, rows):
    return spark.createDataFrame([(t, x, s, 1, "n", 5) for t, x, s in rows], "text string, lang string, source string, digest long, term string, n long")


def mixed(seed, n=120):
    r = random.Random(seed)
    words = ["Ab", "aB", "ab1cd", "é", "É", "漢字", "x", "zz", "don't", "naïve", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = [(" ".join(r.choices(words, k=r.randrange(0, 30))), r.choice(["en", "de"]), r.choice(["a", "b", "c", "é"])) for _ in range(n)]
    return [*rows, *rows[:4], (None, "en", "a"), ("", "en", "void"), ("ab zz", None, None), (None, "xx", "only"), ("12 34 !", "xx", "other"), ("Ab", "en", None), ("long " * 30_000 + "tail", "de", "a")]


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_divergence_by_brute_force(spark, bits):
    rows = mixed(bits)
    got = sorted(tuple(r) for r in divergence.audit(corpus(spark, rows), min_docs=4, top=6, bits=bits).collect())
    assert got == brute_divergence(rows, 4, 6)
    assert {r[0] for r in got} >= {"en", "de", "xx"} and any(r[2] == "pair" and r[4] == 0 for r in got if r[0] == "xx")


@pytest.mark.parametrize("name", ["CELLS", "TERMS"])
def test_divergence_in_several_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(divergence, name, 5)
    rows = mixed(9)
    assert sorted(tuple(r) for r in divergence.audit(corpus(spark, rows), min_docs=4, top=6).collect()) == brute_divergence(rows, 4, 6)


def test_divergence_of_nothing_and_of_one_source(spark):
    assert divergence.audit(corpus(spark, []).limit(0)).count() == 0
    rows = [("one two", "en", "a")] * 12
    assert divergence.audit(corpus(spark, rows)).count() == 0  # no other source, and no term above its language
    assert brute_divergence(rows, 10, 10) == []


# --- quality rules on shared lines ------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def plain(line):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))
    return " ".join("0" if re.fullmatch("[0-9]+", x) else x for x in words)


def brute_judge(rows, max_docs, min_left):
    """rows (id, text, host): what ``judge`` returns."""
    docs = defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if plain(line):
                docs[host or "", plain(line)].add(text)
    out = []
    for i, text, host in rows:
        base = brute_base(text)
        gone = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (text or "").split("\n") if plain(x) and len(docs[host or "", plain(x)]) > max_docs)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        out.append((i, *base, gone, failed, not failed and base[0] - gone >= base[0] * min_left))
    return sorted(out, key=repr)


def hosted(spark, rows):
    return spark.createDataFrame([(h, i, t, 1, 2, "l") for i, t, h in rows], "source string, doc_id long, text string, row long, gone long, lines string")


def lined(seed, n=60):
    r = random.Random(seed)
    own = lambda k: " ".join(f"{r.choice('abcdé')}{r.randrange(400)}" for _ in range(k))
    shared = ["Copyright 2021 by Host. All rights reserved.", "Read MORE about it | here", "Menu  Home  Search", "Cookie notice: we use cookies on this page to serve you better than all others"]
    rows = []
    for i in range(n):
        lines = [own(r.randrange(1, 25)) for _ in range(r.randrange(1, 5))] + [re.sub("2021", str(2000 + i), x) for x in r.sample(shared, r.randrange(0, 4))]
        lines += r.choices(lines, k=r.randrange(0, 3)) + ["", " \t", "*** | ***"] * r.randrange(0, 2)
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), r.choice(["h0", "h0", "h1", None])))
    phrase = own(10)
    return [*rows, (100, " ".join([phrase] * 4), "h0"), (101, None, "h0"), (102, "", None), (103, "\n\n", "h1"), (104, own(30_000), "h1"), (104, own(30_000), "h1"), (None, own(30), "h0"), *[rows[3]] * 15, (105, "漢字 ß x É\n" * 3, "h0")]


@pytest.mark.parametrize("seed", [1, 2])
def test_judge_by_brute_force(spark, seed):
    rows = lined(seed)
    got = line_quality.judge(hosted(spark, rows), max_docs=5, min_left=0.6)
    want = brute_judge(rows, 5, 0.6)
    assert sorted((tuple(r) for r in got.select("rid", *line_quality.BASE, "removed_words", "base_failed", "kept").collect()), key=repr) == want
    assert {r[-1] for r in want} == {True, False} and any(r[6] and not r[7] and not r[8] for r in want)


def test_clean_removes_the_frequent_lines_only(spark):
    rows = lined(3)
    d = hosted(spark, rows)
    kept = [r for r, v in zip(sorted(rows, key=lambda r: repr(r[0])), sorted(brute_judge(rows, 5, 0.6), key=lambda r: repr(r[0]))) if v[-1]]
    docs = defaultdict(set)
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            docs[host or "", plain(line)].add(text)
    want = sorted((i, "\n".join(x for x in t.split("\n") if not (plain(x) and len(docs[h or "", plain(x)]) > 5)), h) for i, t, h in kept if i is not None)
    out = line_quality.clean(d, max_docs=5, min_left=0.6)
    assert out.columns == d.columns
    assert sorted((tuple(r) for r in out.where("doc_id is not null").select("doc_id", "text", "source").collect()), key=repr) == sorted(want, key=repr)


def test_copies_of_a_text_make_no_line_frequent(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    got = line_quality.judge(hosted(spark, [(i, text, "h") for i in range(300)])).collect()
    assert len(got) == 300 and all(r.kept and not r.removed_words for r in got)


def test_share_of_a_large_host_and_empty_tables(spark):
    rows = [(i, " ".join(f"q{i}v{j}" for j in range(25)) + ("\nfooter of the page" if i < 30 else ""), "h") for i in range(60)]
    d = hosted(spark, rows)
    gone = lambda **a: sum(r.removed_words for r in line_quality.judge(d, **a).collect())
    assert gone(max_docs=10) == 4 * 30 and gone(max_docs=10, max_share=0.5) == 0 and gone(max_docs=30) == 0
    assert line_quality.judge(d.limit(0)).count() == 0 and line_quality.clean(d.limit(0)).count() == 0


# --- centroid clustering ----------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, salt):
    rows = [(i, x) for i, x in rows]
    ranked = sorted(rows, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in ranked[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in rows:
            own[near(x)[1]].append(x)
        for j, xs in own.items():
            c[j] = [sum(v) // len(xs) for v in zip(*xs)]
    found = [(i, *near(x)[::-1]) for i, x in rows]
    sums = Counter()
    for _, j, d in found:
        sums[j] += d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


COLS = ["rid", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, vector array<long>, cluster int, x int")


@pytest.mark.parametrize("seed,n,k,span", [(1, 300, 12, 40), (2, 200, 40, 2), (3, 9, 12, 5), (4, 60, 1, 3), (5, 50, 7, 1 << 29)])
def test_clusters_by_brute_force(spark, seed, n, k, span):
    """Close grids have many ties, large integers leave 64 bits."""
    r = random.Random(seed)
    rows = [(i, [r.randrange(-span, span + 1) for _ in range(4)]) for i in range(n)]
    rows += rows[:5]
    odd = [(900, None), (901, [1, None, 2, 3]), (902, [1, 2]), (903, [])]
    got = centroids.cluster(vectors(spark, rows + odd), k, 4, "2", dims=4)
    assert sorted((tuple(r) for r in got.select(*COLS).collect()), key=repr) == brute_clusters(rows, k, 4, "2")


def test_orchard_measures_few_distances_of_separate_groups():
    r = np.random.default_rng(0)
    c = (r.normal(size=(40, 8)) * 4000).astype(np.int64)
    x = np.repeat(c, 50, axis=0) + r.integers(-20, 20, (2000, 8))
    best, near, measured = centroids.orchard(x, c, *centroids.neighbour_lists(c))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all() and measured.mean() < 15


def test_clusters_of_nothing_and_of_one(spark):
    assert centroids.cluster(vectors(spark, [(1, None)]), dims=4).count() == 0
    one, = centroids.cluster(vectors(spark, [(None, [1, -2, 3, 4])]), dims=4).collect()
    assert (one.rid, one.cluster, one.distance, one.inertia) == (None, 0, 0, 0)


def test_line_spans_are_those_of_split():
    texts = ["a\nb", "", "\n", "x", "y\n\nz \n"]
    (_, _, w), = slices(__import__("pyarrow").array(texts))
    text, start, stop = line_quality._lines(w.raw, w.bounds)
    assert [(t, bytes(w.raw[a:b]).decode()) for t, a, b in zip(text, start, stop)] == [(i, x) for i, t in enumerate(texts) for x in t.split("\n") if x]
