"""The pipeline against its operators one by one, and corpus queries against their SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cartlens.llm import bpe, langid, orderhash, packing, pii, quality, queries
from cartlens.llm.storage import drop, kept

SMALL = "/root/testdata/sf0.001"


def test_sql_counterparts(spark):
    duck = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    texts = queries.oracle_sql()
    assert len(texts) == 6
    for name, sql in texts.items():
        found = queries.queries()[name](spark, SMALL)
        expected = duck.sql(sql)
        assert expected.columns == found.columns
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected.fetchall(), key=str), name


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.fixture(scope="module")
def passed(spark):
    """What each stage returns."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(kept(stage(spark, found[-1], SMALL), name))
    return found


def test_stages_take_effect(spark, passed):
    docs, by_language, good, single, private, pieces = passed
    for frame in (by_language, good, single, private):
        assert frame.columns == docs.columns
    languages, model = langid.fit(docs, "doc_id", "text", "lang")
    rejected = {r["id"] for r in langid.identify(docs, "doc_id", "text", languages, model, host=F.col("source")).where("rejected").collect()}
    ids = lambda frame: sorted(r["doc_id"] for r in frame.select("doc_id").collect())
    assert ids(by_language) == [i for i in ids(docs) if i not in rejected]

    field = queries.quality_field(spark, SMALL, by_language)
    scores = by_language.select("doc_id", quality.score("text", field).alias("s")).collect()
    assert ids(good) == sorted(r["doc_id"] for r in scores if r["s"] >= quality.GOOD_AT)

    assert ids(single) == sorted(r["doc_id"] for r in orderhash.classes(good, "doc_id", "text").where("kept").collect())

    before = {r["doc_id"]: r["text"] for r in single.collect()}
    spans = {r["carried"]["doc_id"]: r["spans"] for r in pii.spans(single, "text", ["doc_id"]).collect()}
    for r in private.collect():
        expected, at = "", 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                expected += before[r["doc_id"]][at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert r["text"] == expected + before[r["doc_id"]][at:] and r["n_chars"] == len(r["text"])

    sizes = {r["id"]: len(r["ids"]) + 1 for r in bpe.encode_texts(private, "doc_id", "text").collect()}
    held = {}
    for r in pieces.collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= packing.WINDOW
    assert held == sizes


def test_run_gives_the_last_stage(spark, passed):
    found = corpus_pipeline.run(spark, SMALL)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert len(found.columns) == 7 and found.count() > 0
    assert {r["doc_id"] for r in map(lambda r: r.asDict(), found.collect())} == {r["doc_id"] for r in passed[-1].collect()}
    assert corpus_pipeline.ORACLE_SQL is None and key is not None


def test_odd_documents_pass_all_stages(spark, odd, empty, prose, documents_of):
    good = documents_of([(1000 + i, prose(80, i)) for i in range(20)] + [(1000, prose(80, 0)), (None, prose(80, 50)), (None, prose(80, 51))])
    for start in (odd.unionByName(good).withColumn("a.b", F.lit(1)), empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = kept(stage(spark, docs, SMALL), name)
            assert name == "packing" or docs.columns == start.columns
        ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect()]
        assert (ids == []) == (start is empty)


def test_rows_are_decided_on_for_themselves(spark, prose):
    """Different texts under one id all stay; copies go, whatever their ids."""
    texts = [prose(60, 500 + k) for k in range(120)]
    rows = [(k % 60, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (None, prose(60, 900)), (7, texts[100])]
    docs = kept(spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string"), "docs")
    left = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert left.columns == docs.columns
    assert sorted(r["text"] for r in left.collect()) == sorted([*texts, prose(60, 900)])
    assert {r["doc_id"] for r in left.collect()} == {*range(60), None}
    assert corpus_pipeline.language_id(spark, docs, SMALL).columns == docs.columns


def test_stages_delete_what_the_one_before_has_left(spark, passed):
    """Only the tables of the last stage are there, not those of the stages before."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = kept(corpus_pipeline.language_id(spark, docs, SMALL), "first")
    folders = [Path(f.removeprefix("file:")) for f in corpus_pipeline._left]
    assert folders and any(f.exists() for f in folders)
    second = kept(corpus_pipeline.personal_data(spark, first, SMALL), "second")
    assert not any(f.exists() for f in folders)
    assert second.count() == first.count() > 0


def test_only_results_stay(spark, prose, documents_of, tmp_path, monkeypatch):
    """Of the tables that near-duplicate classes write, the result alone is left."""
    from cartlens.llm import storage

    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    base = prose(60, 1)
    rows = [(k, prose(60, k % 12)) for k in range(30)] + [(100 + k, base.replace(w, f"new{k}", 1)) for k, w in enumerate(base.split()[:20])]
    found = orderhash.classes(documents_of(rows), "doc_id", "text")
    assert found.where("kept").count() == 12
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["classes"]


def test_kept_tables_can_be_dropped(spark):
    frame = kept(spark.range(5).toDF("x"), "trial")
    assert frame.count() == 5
    drop(frame)
    assert not any(Path(f.removeprefix("file:")).exists() for f in frame.inputFiles())
