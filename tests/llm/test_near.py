"""SimHash, decontamination, embeddings and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postings_engine.llm import decontam, embeddings, simhash
from postings_engine.llm.graph import components

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {
        "chain": [(i, i + 1) for i in range(300)], "star": [(999, i) for i in range(300)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(220)], "none": [],
    }[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == plain_components(nodes, [x for x in links if x[0] != x[1]])


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text("aAÄß 1\n\t\x0b \x1c", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == simhash.signed(plain_fingerprint(text))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=3))
def test_cover_misses_no_pair(differing):
    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15
    assert any(all(not m >> b & 1 for b in differing) for m in masks)


@pytest.mark.parametrize("split_over", [512, 3])
def test_simhash_matches_brute_force(spark, documents, prose, monkeypatch, split_over):
    monkeypatch.setattr(simhash, "SPLIT_OVER", split_over)
    rng = random.Random(2)
    rows = [(i + 10, prose(i, 80)) for i in range(60)]
    for i in range(150):  # near copies of one text, and of some others
        words = prose(0 if i % 2 else i % 9, 80).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = "zz"
        rows.append((500 + i, " ".join(words)))
    rows += [(5, ""), (4, None), (9, "\n"), (7, prose(3, 80)), (7, prose(3, 80)), (None, prose(3, 80)), (8, "one"), (3, "one two"), (2, "ONE")]
    df = documents(rows).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    got = simhash.near_duplicates(df).collect()
    prints = [(i, plain_fingerprint(t or "")) for i, t in rows]
    links = [(a, b) for a, x in prints for b, y in prints if a is not None and b is not None and (x ^ y).bit_count() <= 3]
    roots = plain_components({i for i, _ in prints if i is not None}, links)
    want = sorted(((i, simhash.signed(x), roots.get(i)) for i, x in prints), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def plain_align(item, part):
    """Smith-Waterman, cell by cell."""
    rows, best = [[0] * (len(part) + 1)], 0
    for x in item:
        row = [0]
        for j, y in enumerate(part, 1):
            row.append(max(0, rows[-1][j - 1] + (decontam.MATCH if x == y else decontam.MISMATCH), rows[-1][j] + decontam.GAP, row[-1] + decontam.GAP))
        best = max(best, *row)
        rows.append(row)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(-1, 4), max_size=20))
def test_alignment(item, part):
    score, start, end, matched = decontam.align(np.array(item), np.array(part, np.int64))
    assert score == plain_align(item, part)
    assert 0 <= start <= end <= len(part) and matched <= min(len(item), end - start)
    assert plain_align(item, part[start:end]) == score


@pytest.mark.parametrize("every", [3, 4, 5])
@pytest.mark.parametrize("copies", [0, 300])
def test_edited_copies(spark, documents, prose, every, copies):
    """A word in every few replaced: found as full alignment says, alone or beside verbatim copies."""
    rows, items = [], [(k, " ".join(f"{w}{k}{at}" for at, w in enumerate(prose(k, 40).split()))) for k in range(4)]
    for k, item in items:
        edited = [w if (at + k) % every else "zzz" for at, w in enumerate(item.split())]
        rows += [(k, f"{prose(50, 20)} {' '.join(edited)} {prose(51, 30)}")] + [(1000 * k + 100 + c, item) for c in range(copies)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, k) for d, t in rows for k, item in items if plain_align(item.split(), t.split()) >= decontam.MIN_SCORE * 2 * len(item.split())} \
        if copies < 2 else {(k, k) for k, _ in items if every > 3} | {(1000 * k + 100 + c, k) for k, _ in items for c in range(copies)}
    assert got == want and (every == 3 or len(got) == 4 * (copies + 1))


def test_short_items_and_scripts_without_blanks(spark, documents):
    items = [(1, "Eureka"), (2, "blue moon"), (3, "日本語の文章です"), (4, "...")]
    rows = [(10, "He said eureka!"), (11, "once in a blue, moon"), (12, "blue and moon"), (13, "これは日本語の文章です。短い文"), (14, "日本の文"), (15, "nothing")]
    found = decontam.contaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(10, 1), (11, 2), (13, 3)}


def test_alignment_of_long_items_stays_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    item = rng.integers(0, 5000, 6000)
    part = np.concatenate([rng.integers(0, 5000, 3000), np.where(rng.random(6000) < 0.9, item, -1), rng.integers(0, 5000, 3000)])
    tracemalloc.start()
    score, start, end, matched = decontam.align(item, part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and 5200 < matched <= 6000 and 2900 < start < 3100 and 8900 < end < 9100 and score > 0.6 * 2 * 6000


def test_decontamination_matches_brute_force(spark, documents, prose):
    rng = random.Random(4)
    items = [(k, prose(1000 + k, rng.randint(15, 50))) for k in range(20)] + [(50, "de de de de de de de de de de"), (51, None), (52, ""), (53, "ba da"), (54, prose(1000, 9)), (None, prose(77, 20))]
    rows = []
    for i in range(200):
        text, item = prose(i, rng.randint(0, 150)), (items[i % 20][1] or "").split()
        if i % 4 == 0:  # an edited copy: a word in eight replaced, dropped or put in
            first = rng.randint(0, 7)
            edited = [x for at, w in enumerate(item) for x in ([w] if at % 8 != first else rng.choice([["zzz"], [], [w, "yyy"]]))]
            text = f"{text}\n{' '.join(edited).upper()}! {prose(i + 5000, 30)}"
        rows.append((i, text))
    rows += [(300 + i, items[0][1]) for i in range(50)] + [(900, None), (901, ""), (None, items[1][1]), (902, "de " * 5000), (1, items[2][1])]
    df = documents(rows).withColumn("item_id", F.lit("x")).withColumn("score", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = decontam.contaminated(df, bench).collect()
    got = {(r["doc_id"], r["item_id"], round(r["score"], 6)) for r in found}
    want = set()
    for i, t in rows:
        ws = decontam.words(t or "")
        for k, item in items:
            its = decontam.words(item or "")
            if 0 < len(its) < decontam.SEED_WORDS:  # word for word only
                if any(ws[p:p + len(its)] == its for p in range(len(ws))):
                    want.add((i, k, 1.0))
            elif its and set(its) & set(ws):
                score = plain_align(its, ws) / (decontam.MATCH * len(its))
                if score >= decontam.MIN_SCORE:
                    want.add((i, k, round(score, 6)))
    assert len(want) > 100 and got == want
    blocks = decontam.contaminated(df, bench, block_words=60).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, found))
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def vectors(seed, groups, each, spread, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [c + spread * np.linalg.norm(c) * rng.normal(size=dims) / np.sqrt(dims) for c in centres for _ in range(each)]


def plain_links(rows):
    units = [(i, embeddings.unit(v)) for i, v, _ in rows]
    count, links = [], []
    for n, (i, u) in enumerate(units):
        near = [m for m, (j, v) in enumerate(units) if m != n and i is not None and j is not None and u is not None and v is not None
                and len(u) == len(v) and u @ v >= 0.95]
        count.append(len(near))
        links += [(i, units[m][0]) for m in near]
    roots = plain_components({i for i, _ in units if i is not None}, links)
    return sorted(((i, c, roots.get(i), i is not None and roots[i] == i) for (i, _), c in zip(units, count)), key=str)


def as_rows(found):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in found]


@pytest.mark.parametrize("most", [4096, 100])
def test_embeddings_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(embeddings, "MOST", most)
    monkeypatch.setattr(embeddings, "CLUSTER", 50)
    points = vectors(1, 150, 1, 0.0) + vectors(2, 12, 8, 0.12) + vectors(3, 1, 90, 0.1)
    found = list(enumerate(np.float32(points)))
    found += [(1000 + k, np.float32(points[k % 3])) for k in range(60)]  # copies
    found += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2005, [None, 1.0]),
              (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, points[0]), (5, np.float32(points[5])), (2008, [1e-38] * 24), (2009, [3e38] * 24)]
    df = spark.createDataFrame(as_rows(found), VECTORS).withColumn("kept", F.lit("x")).withColumn("unit", F.lit(1))
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    want = plain_links([(r["vec_id"], r["embedding"], 0) for r in df.collect()])
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g == w for g, w in zip(got, want)) >= 0.98 * len(want)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.002, 0.17])
def test_links_of_a_noisy_group_larger_than_a_cluster_are_all_found(spark, monkeypatch, spread):
    for name, value in (("MOST", 200), ("CLUSTER", 50), ("SAMPLE", 200), ("BLOCK", 150)):
        monkeypatch.setattr(embeddings, name, value)
    points = np.float32(vectors(4, 1, 900, spread) + vectors(5, 300, 1, 0.0))
    df = spark.createDataFrame(as_rows(enumerate(points)), VECTORS)
    units = np.stack([embeddings.unit(p) for p in points])
    true = (units @ units.T >= 0.95) & ~np.eye(len(units), dtype=bool)
    assert true[:900].sum(axis=1).max() > 4 * 200
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.999 * true.sum()
    assert all(got[i]["n_links"] <= true[i].sum() for i in got)


def test_links_are_compared_exactly_when_the_search_stays_short(spark, monkeypatch):
    nothing = lambda rows, settings: rows.selectExpr("node", "0L as links", "node as root")
    monkeypatch.setattr(embeddings, "search", nothing)
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    df = spark.createDataFrame(as_rows(enumerate(np.float32(vectors(6, 100, 2, 0.05)))), VECTORS)
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == plain_links([(r["vec_id"], r["embedding"], 0) for r in df.collect()])


def test_audit_counts_pairs_missed_at_both_ends(spark):
    points = np.float32(vectors(7, 50, 2, 0.05))
    rows = [(20 * i, embeddings.unit(p).tobytes(), 1) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "node long, unit binary, n long")
    found = spark.createDataFrame([(r[0], int(i >= 40)) for i, r in enumerate(rows)], "node long, links long")
    assert embeddings.audit(df, found, embeddings.Settings()) == (0.6, 100)
