"""The corpus pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
from postings_engine.llm import decontam, langid, packing, queries

from .test_near import plain_align, plain_components, plain_fingerprint
from .test_rows import plain_lines, windows_of


def test_unrecognised_texts_go(spark, documents, prose):
    rng = random.Random(5)
    write = lambda seed, letters: " ".join("".join(random.Random(f"{seed} {k}").choices(letters, k=5)) for k in range(40))
    rows = [(i, write(i, ("abcd", "efgh", "ijkl", "mnop")[i % 4]), "wxyz"[i % 4]) for i in range(160)]
    rows += [(900, "".join(rng.choices("qrstuv 0123456789", k=400)), None), (901, "日本語の文章です。" * 20, None), (902, "qq", None), (903, "12 34", None), (904, None, None)]
    out = corpus_pipeline.language_id(spark, documents(rows), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(160), 902]


def test_run_matches_brute_force(spark, documents, prose, tmp_path):
    rows = [(i, prose(i, 60, "aa") + f"\nfooter of all\n{prose(i + 900, 8)}", "aa") for i in range(60)]
    rows += [(100 + i, prose(7, 70, "bb") + (" end" if i % 2 else ""), "bb") for i in range(8)]  # copies
    rows += [(200 + i, "one\ntwo footer\none", "aa") for i in range(12)]  # all lines repeat
    rows += [(300, "12 34", "aa"), (301, None, None), (302, "", "bb"), (None, prose(55, 30, "bb"), "bb")]
    items = [(k, prose(5000 + k, 25, "bb")) for k in range(4)]
    rows += [(400 + k, f"{prose(600 + k, 30, 'aa')} {items[k][1]}", "aa") for k in range(4)]
    df = documents(rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Language: of two languages one is always likelier, so only documents without a letter are rejected.
    left = [(i, t) for i, t, *_ in rows if any(map(str.isalpha, t or ""))]
    blank = re.compile(r"[ \t\n\x0b\f\r]*")
    out = plain_lines(left, 10, True)
    left = [(i, kept) for i, _, dropped, kept in out if not dropped or not blank.fullmatch(kept)]
    assert 200 in dict(left) and 201 not in dict(left)
    prints = {i: plain_fingerprint(t) for i, t in left if i is not None}
    roots = plain_components(set(prints), [(a, b) for a, x in prints.items() for b, y in prints.items() if (x ^ y).bit_count() <= 3])
    left = [(i, t) for i, t in left if i is None or roots[i] == i]
    leaks = lambda t: any(plain_align(decontam.words(x), decontam.words(t)) >= 0.6 * 2 * len(decontam.words(x)) for _, x in items)
    left = [(i, t) for i, t in left if not leaks(t)]
    assert not {400, 401, 402, 403} & {i for i, _ in left} and 100 in dict(left) and 102 not in dict(left)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    files = packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken")
    want = Counter((i, len(packing.encode(t, *files)) + 1) for i, t in left)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    windows_of(got, packing.WINDOW)


def test_stages_return_the_columns_of_documents(spark, documents, prose, tmp_path):
    rows = [(i, prose(i, 30), "aa") for i in range(12)]
    docs = documents(rows).selectExpr("*", "1 as score", "'x' as `_row`", "2 as kept", "3 as `a.b`")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 12, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert langid.UNDETERMINED == "und"


def test_documents_with_letters_stay_when_no_language_is_learned(spark, documents, prose):
    rows = [(i, prose(i, 20), None) for i in range(12)] + [(50, "12 34"), (51, None), (52, "")]
    out = corpus_pipeline.language_id(spark, documents(rows), "")
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(12))
