"""The divergence audit against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postings_engine.llm import divergence

_RUNS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return _RUNS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain_audit(rows, min_documents=3, top=200):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = plain_terms(text or "")
        groups[lang].add(source)
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= min_documents]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def p(count, n):
            return 1 + 10 ** 9 * (count + 1) // (n + len(kept))

        share = {s: {t: p(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        whole = {t: p(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pair = [(-sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in sources if o != s]
            term = [(-((share[s][t] - whole[t]) ** 2 // whole[t]), t) for t in kept if counts[lang, s][t] and share[s][t] > whole[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:limit], 1):
                    out.append((lang, s, part, item, -value, rank))
    return sorted(out)


@settings(max_examples=100, deadline=None)
@given(st.text("aAzZÄß1_[`{@ \n\x00\x7f日", max_size=40))
def test_terms(text):
    assert [t.decode() for t in divergence.terms(text)] == plain_terms(text)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)), st.sampled_from([1, 3, 64]))
def test_gallop(a, b, stride):
    short, long = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    mine, theirs = divergence.gallop(short, long, stride)
    assert short[mine].tolist() == long[theirs].tolist() == sorted(a & b)


def test_share_is_exact():
    count = np.array([1, 7, 10 ** 9, 2 * 10 ** 14], np.int64)
    for total in (2 * 10 ** 14, 2 * 10 ** 14 + 12345):
        assert divergence.share(count, total).tolist() == [1 + 10 ** 9 * int(c) // total for c in count]


@pytest.mark.parametrize("bucket, held", [(1 << 16, 400_000), (5, 7)])
def test_audit(spark, documents, monkeypatch, bucket, held):
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeÄ日Z", k=rng.randint(1, 3))) for _ in range(60)]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30]))), rng.choice(["en", "de", None]), rng.choice(["x", "y", "Ä", "z", None]))
            for _ in range(150)]
    rows += [rows[0]] * 5 + [(None, "en", "empty"), ("", "fr", "one"), (None, "fr", "two"), ("solo solo", "it", "only")] + [("wort " * 30_000, "de", "y")]
    docs = documents([(i % 40, *r) for i, r in enumerate(rows)])
    clash = docs.selectExpr("*", "1 AS term", "2 AS n", "3 AS total", "4 AS bucket")
    got = sorted(tuple(r) for r in divergence.audit(clash).collect())
    assert got == plain_audit(rows)


def test_top_terms_and_empty(spark, documents):
    docs = documents([(i, " ".join(f"t{chr(97 + k)}" for k in range(10)), "en", "s") for i in range(3)] + [(9, "q q", "en", "r")])
    got = divergence.audit(docs, top_terms=4).filter("part = 'term' and source = 's'").collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] in ([1, 2, 3, 4], [])
    assert divergence.audit(documents([])).collect() == []
