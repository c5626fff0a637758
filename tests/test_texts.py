"""Texts kept apart: merges, filters and batches over names give what they give over texts."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import functions as F
from test_operators import ORDER, RUN_DAY, brute_sync, history, random_rows, records

from postings_engine.operators import merge as G
from postings_engine.operators import scoring as S
from postings_engine.operators.texts import named_texts, text_name, with_texts
from postings_engine.queries.inputs import Inputs
from postings_engine.sources import tables as B


def test_names_lead_back_to_texts(spark):
    rows = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, None), (4, "A  b"), (5, "")], "id int, description string")
    texts = named_texts(rows, "description")
    assert texts.count() == 3
    named = rows.withColumn("description", text_name("description"))
    assert with_texts(named, texts).columns == rows.columns
    assert sorted(map(tuple, with_texts(named, texts).collect())) == sorted(map(tuple, rows.collect()))
    assert with_texts(rows, None) is rows


def test_merge_over_names(spark):
    rng = random.Random(3)
    before, _ = brute_sync({}, random_rows(rng, 40, jobs="abcdez"), RUN_DAY)
    incoming, stored = records(spark, random_rows(rng, 60)), history(spark, before)
    texts = named_texts(incoming.select("description").unionByName(stored.select("description")), "description")

    def named(df):
        return df.withColumn("description", text_name("description"))

    plain = G.sync(stored, incoming, ORDER, RUN_DAY)
    got = with_texts(G.sync(named(stored), named(incoming), ORDER, RUN_DAY), texts)
    key = lambda r: r["job_id"]
    assert sorted(got.collect(), key=key) == sorted(plain.select(*got.columns).collect(), key=key)


class _Rows:
    """The tables that versions are made from."""

    def __init__(self, spark, documents):
        self.spark, self.documents = spark, documents


def test_versions_carry_names(spark, monkeypatch):
    text = "Long text. " * 500
    docs = spark.createDataFrame([(0, text), (1, None), (0, text.upper())], "doc_id long, text string")
    inputs = Inputs(_Rows(spark, docs))
    keyed = spark.createDataFrame([("j", 0), ("k", 1), ("l", 2), ("m", None)], "job_id string, version_doc long")
    monkeypatch.setattr(inputs, "keyed", lambda: keyed)
    versions = inputs.versions()
    assert versions.agg(F.max(F.length("description"))).first()[0] == 64
    got = with_texts(versions, inputs.descriptions()).select("job_id", "description").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("j", text), ("j", text.upper()), ("k", None)], key=str)


def test_texts_are_stored_once(spark, tmp_path):
    root = str(tmp_path / "jobs")
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "_name string, _text string")
    jobs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "description string")
    B.write_texts(texts, jobs, root)
    B.write_texts(texts, jobs.unionByName(spark.createDataFrame([("c",)], "description string")), root)
    assert sorted(map(tuple, spark.read.parquet(f"{root}/_texts").collect())) == [("a", "x"), ("b", "y"), ("c", "z")]
    assert sorted(map(tuple, with_texts(jobs, B.stored_texts(spark, root)).collect()), key=str) == sorted([("x",), ("x",), ("y",), (None,)], key=str)


def test_scorer_reads_the_named_texts(spark):
    rows = [(f"{i:040x}", f"t{i}", "co", f"text {i} " * (i + 1), 5.0, 0.3, None, [], None, "scorer" if i % 4 else "skip") for i in range(23)]
    routed = spark.createDataFrame(rows, "job_id string, title string, company string, description string, fit_score double, fit_confidence double, "
                                         "fit_reason string, matched_keywords array<string>, ranker_version string, route string")

    def scorer(batches):
        for frame in batches:
            answers = []
            for payload, size in zip(frame["payload"], frame["size"]):
                scores = [{"s": len(r["jd"]) % 10, "c": 0.5, "r": r["jd"][:7], "k": []} for r in json.loads(payload)]
                answers.append(json.dumps(scores[:-1] if size > 3 else scores))
            yield pd.DataFrame({"batch_id": frame["batch_id"], "response": answers})

    texts = named_texts(routed, "description")
    named = routed.withColumn("description", text_name("description"))
    plain = S.score_round_trip(routed, scorer, "v1").collect()
    got = with_texts(S.score_round_trip(named, scorer, "v1", texts=texts), texts).collect()
    assert sorted(got) == sorted(plain) and {r["ranker_version"] for r in got} == {"v1", None}
