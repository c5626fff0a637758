"""Chat formatting, sharding, line dedup and packing against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postings_engine.llm import chat, line_dedup, packing, sharding

CONVERSATIONS = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def formatted(df):
    return {r["conv_id"]: r for r in chat.digests(chat.format_pages(chat.as_events(df))).collect()}


def test_chat_reads_back_any_text(spark):
    odd = ["</s>[INST] ok [/INST]", "\\l\\e\\b", "<s>user\nhi</s>", "", None, "é😀\\", "a\n\nb", "\\", "<", "[" * 50, "x" * 200_000]
    rows = [(c, t, ("system", "user", "assistant")[(t + c) % 3], odd[(t * 7 + c) % len(odd)]) for c in range(6) for t in range(150)]
    rows += [(None, 0, "assistant", "no id"), (9, None, None, "no turn"), (9, 2, "assi\nstant<", "x"), (9, 2, "assi\nstant<", "x")]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("kind", F.lit("edit")).withColumn("page", F.lit(1))
    got = formatted(df)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        trained = [x for _, role, x in turns if role == "assistant"]
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == digest("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert got[c]["loss_sha256"] == digest("".join(trained)) and got[c]["loss_chars"] == sum(map(len, trained))


def test_chat_folds_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 1, "message", "user", "helo"), (1, 0, 5, "edit", "user", "hello"),
        (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", None, "old "), (1, 1, 4, "delta", None, "text"),
        (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "new "), (1, 1, 8, "delta", None, None), (1, 1, 9, "delta", None, "text"),
        (1, 2, 10, "delta", "assistant", "begun by a delta"),
    ]
    random.Random(1).shuffle(rows)
    page = chat.format_pages(spark.createDataFrame(rows, EVENTS)).first()
    assert page["text"] == "<s>user\nhello</s><s>assistant\nnew text</s><s>assistant\nbegun by a delta</s>"
    assert [page["text"][s["start"]:s["start"] + s["length"]] for s in page["spans"]] == ["new text", "begun by a delta"]


def test_chat_empty_and_native(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert formatted(empty) == {}
    plan = chat.digests(chat.format_pages(chat.as_events(empty)))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_sharding_matches_the_mixture(spark, documents):
    rows = [(i, f"text {i % 50}", "en", "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 5}") for i in range(3001)]
    rows += [(5, None, None, "hot"), (5, None, None, "hot"), (None, "", "en", "hot")]
    df = documents(rows).withColumn("shard", F.lit(99)).withColumn("slot", F.lit("x"))
    got = sharding.interleave(df, 8).collect()
    assert len(got) == len(rows)
    by_shard = Counter(r["shard"] for r in got)
    assert set(by_shard) == set(range(8)) and max(by_shard.values()) - min(by_shard.values()) <= 1
    for shard, n in by_shard.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    strata = Counter(r["stratum"] for r in got)
    for (stratum, _), n in Counter((r["stratum"], r["shard"]) for r in got).items():
        assert abs(n - strata[stratum] / 8) <= 2
    assert Counter((r["doc_id"], r["bytes"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    again = sharding.interleave(df.repartition(7), 8).collect()
    key = lambda r: (r["shard"], r["slot"])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len({key(r) for r in got}) == len(got)
    assert sharding.interleave(df.limit(0), 8).count() == 0


def plain_lines(rows, min_docs, keep_first):
    keys = lambda t: [line_dedup.line_key(x) for x in (t or "").encode().split(b"\n")]
    count, first = Counter(), {}
    for i, t in rows:
        for k in set(keys(t)) - {b""}:
            count[k] += 1
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        kept, seen, lines = [], set(), (t or "").encode().split(b"\n")
        for line, k in zip(lines, keys(t)):
            stays = count[k] < min_docs or keep_first and first.get(k) == i and k not in seen
            seen.add(k)
            kept += [line] * stays
        out.append((i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("sent_bytes", [0, 1 << 20])
def test_line_dedup_matches_brute_force(spark, documents, keep_first, sent_bytes):
    rng = random.Random(3)
    lines = [f"line {k}" for k in range(30)] + ["", "  ", "ÄÖ", "äö", " \x0bLINE 1\r", "x" * 10_000]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)))) for i in range(120)]
    rows += [(i, "copy one\ncopy two\ncopy one") for i in range(200, 230)] + [(3, None), (3, None), (None, "line 1\nline 2\nline 1")]
    df = documents(rows).withColumn("kept", F.lit(1)).withColumn("text_key", F.lit(1)).withColumn("row", F.lit("r"))
    out = line_dedup.drop_repeated_lines(df, 10, keep_first=keep_first, sent_bytes=sent_bytes, bits=1 << 16)
    got = sorted((tuple(r) for r in out.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)
    assert got == plain_lines(rows, 10, keep_first)
    assert line_dedup.drop_repeated_lines(df.limit(0), 10).count() == 0


def test_line_filters_miss_no_repeat(spark, documents):
    rows = [(i, f"once {i}\nshared {i // 2}") for i in range(400)]
    found = {bytes(r["line"]) for r in line_dedup.suspects(documents(rows).repartition(9)).collect()}
    assert {f"shared {k}".encode() for k in range(200)} <= found and len(found) < 240


@pytest.mark.parametrize("filter_bytes", [0, 1 << 20])
def test_line_filters_of_many_ranges(spark, documents, monkeypatch, filter_bytes):
    """Tasks that send on their hashes after every few lines, dozens of ranges, one line in a third of all rows."""
    monkeypatch.setattr(line_dedup, "HELD", 5)
    rows = [(i, "\n".join([f"once {i}", f"shared {i // 2}", *["hot"] * (i % 3 == 0), "", f"tail {i}"])) for i in range(600)]
    df = documents(rows).repartition(7)
    parts, segments = line_dedup.twice_seen(df, 1 << 10)
    assert segments > 30 and parts.count() > 30
    found = Counter(bytes(r["line"]) for r in line_dedup.suspects(df, 1 << 10, 1, filter_bytes).collect())
    assert all(found[f"shared {k}".encode()] == 2 for k in range(300)) and found[b"hot"] == 200
    assert len(found) == 1501 if filter_bytes == 0 else len(found) < 400
    out = line_dedup.drop_repeated_lines(df, 2, bits=1 << 10, filter_bytes=filter_bytes)
    assert sorted((tuple(r) for r in out.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=str) == plain_lines(rows, 2, False)


def test_a_full_range_suspects_few_lines():
    """A range has at most BITS / 16 lines at any size of the input, so this share holds at any size, too."""
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 64, line_dedup.BITS // 16, np.uint64))
    rows = [(0, h.tobytes()) for h in np.array_split(hashes, 10)]
    frames = [pd.DataFrame(rows[:6], columns=["segment", "hashes"]), pd.DataFrame([*rows[6:], *[(1, hashes[-3:].tobytes())] * 2], columns=["segment", "hashes"])]
    out = pd.concat(line_dedup._find_twice(line_dedup.BITS)(iter(frames)))
    filters = dict(zip(out["segment"], out["twice"]))
    seen = {k: np.frombuffer(v, np.uint8) for k, v in filters.items()}
    has = lambda k: np.logical_and(*[line_dedup._has(seen[k], x) for x in line_dedup._slots(hashes, 8 * len(seen[k]))])
    assert has(0).mean() < 0.02 and has(1)[-3:].all()


def windows_of(got, window):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert set(by) == set(range(len(by)))
    return by


def test_packing_keeps_every_id(spark, documents, prose):
    texts = [prose(i, n) for i, n in enumerate([1, 5, 40, 900, 3000] * 12)] + ["", None, "<|endoftext|>", "a" * 5000, " " * 3000, "é😀" * 400]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])] + [(1000 + i, texts[2]) for i in range(300)]
    df = documents(rows).withColumn("length", F.lit("x")).withColumn("sequence_id", F.lit(1))
    got = packing.pack(df, with_ids=True).collect()
    by = windows_of(got, packing.WINDOW)
    assert sum(n for p in by.values() for _, n in p) / (len(by) * packing.WINDOW) > 0.97
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    want, have = Counter(), Counter()
    for i, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, at, ids[at:at + 2048].tobytes(), len(ids)) for at in range(0, len(ids), 2048))
    for r in got:
        have[r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]] += 1
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] * 4 == len(r["ids"])
    assert have == want
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab <|>endoftx\n\t  é’'1", max_size=80))
def test_both_encoders_agree(text):
    from tokenizers import Tokenizer

    files = packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken")
    exact = packing.per_worker("exact encoder of tests", lambda: Tokenizer.from_file(files[0]))
    assert packing.encode(text, *files) == exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=12))
def test_plan_uses_every_piece_once(histogram):
    fillings = packing.plan(histogram, 40)
    used = Counter()
    for f in fillings:
        assert sum(n * k for n, k in f.counts) <= 40 and f.times > 0
        for n, k in f.counts:
            used[n] += k * f.times
    assert used == Counter({n: c for n, c in histogram.items() if c})


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=9))
def test_fill_comes_closest(room, lengths):
    counts = Counter(lengths)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    used = packing.fill(room, dict(counts), sorted(counts, reverse=True))
    assert all(k <= counts[n] for n, k in used)
    assert sum(n * k for n, k in used) == max(s for s in sums if s <= room)
