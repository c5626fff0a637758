"""Arrays in large files: every element once, wherever the byte ranges cut."""

from __future__ import annotations

import gzip
import json
import random

import pytest

from postings_engine.sources import arrays as A
from postings_engine.sources import feeds
from postings_engine.sources import landing as L
from postings_engine.sources import shapes as H

PIECES = ['"', "\\", "},{", "[", "]", ",", "é", "日本", "\n", "a", ":", '\\"', "😀", " "]


def value(rng, deep=3):
    kind = rng.randrange(6 if deep else 3)
    if kind < 2:
        return "".join(rng.choices(PIECES, k=rng.randrange(6)))
    if kind == 2:
        return rng.choice([1, -2.5, None, True])
    if kind < 5:
        return {"".join(rng.choices(PIECES, k=3)): value(rng, deep - 1) for _ in range(rng.randrange(4))}
    return [value(rng, deep - 1) for _ in range(rng.randrange(4))]


def by_ranges(path, size):
    """All elements as the jobs find them: the state before a range is the sum of what earlier ranges do."""
    total, quotes, depth, out = path.stat().st_size, 0, 0, []
    for start in range(0, total, size):
        out += [e.strip() for e in A.elements(str(path), start, start + size, quotes % 2, depth)]
        q, outside, inside, _ = A.summarise(str(path), start, start + size)
        depth += inside if quotes % 2 else outside
        quotes += q
    return [e for e in out if e]


@pytest.mark.parametrize("chunk", [3, 64, 1 << 20])
def test_elements_of_any_ranges(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(A, "CHUNK", chunk)
    rng = random.Random(chunk)
    for n in range(25):
        rows = [{"k": value(rng)} for _ in range(rng.randrange(7))]
        text = json.dumps(rows, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        path = tmp_path / f"{n}.json"
        path.write_bytes(b"\xef\xbb\xbf" * (n % 2) + text.encode())
        for size in (1, 2, 5, 17, 1000):
            assert [json.loads(e) for e in by_ranges(path, size)] == rows


def test_long_runs_of_backslashes(tmp_path, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 1000)
    for length in (2047, 2048, 5001):
        rows = [{"t": "\\" * length + '"},{"'}, {"t": "x"}]
        path = tmp_path / "a.json"
        path.write_text(json.dumps(rows))
        assert [json.loads(e) for e in by_ranges(path, 999)] == rows


def test_array_files_are_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [{"slug": f"s{i}", "text": value(rng, 0) if i % 2 else "x" * 400} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2), encoding="utf-8")
    with gzip.open(tmp_path / "b.json.gz", "wt", encoding="utf-8") as out:
        json.dump(rows[:20], out)
    (tmp_path / "c.json").write_text(json.dumps({"slug": "one"}), encoding="utf-8")
    (tmp_path / "d.json").write_text(" \n", encoding="utf-8")
    (tmp_path / "e.json").write_text("", encoding="utf-8")
    (tmp_path / "f.json").write_text("[]", encoding="utf-8")
    (tmp_path / "g.json").write_text('[{"slug": "kept"}, {"slug": "cu', encoding="utf-8")
    found = A.read_array_records(spark, str(tmp_path), 1 << 12)
    tasks = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(tasks) == 300 + 20 + 1 + 2 and sum(n > 0 for n in tasks) > 10
    texts = [r["value"] for r in found.collect()]
    broken = '{"slug": "cu'
    assert texts.count(broken) == 1
    got = sorted(json.dumps(json.loads(t)) for t in texts if t != broken)
    assert got == sorted(json.dumps(r) for r in rows + rows[:20] + [{"slug": "one"}, {"slug": "kept"}])
    # No exchange carries a text: what is shuffled are ranges and their states.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "value" in line]


def test_array_feed_through_gather(spark, tmp_path):
    rows = [{"slug": "s1", "text": f"t{i}", "hostedUrl": f"https://x.example/{i}", "createdAt": i} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(rows), encoding="utf-8")
    companies = spark.createDataFrame([("s1", "Acme")], "slug string, name string")
    found = feeds.gather(spark, [(feeds.Postings(companies), str(tmp_path)), (feeds.Postings(companies), str(tmp_path / "absent"))])
    assert {r["title"] for r in found.postings.collect()} == {f"t{i}" for i in range(50)} and len(found.failed) == 1
    landed = L.read_landed(spark, str(tmp_path), H.POSTINGS, multi_line=True)
    assert L.good_records(landed).count() == 50 and L.quarantine(landed, "s").count() == 0
