"""Each stage of the pipeline on nulls in every column, odd texts, repeated rows and ids, and an empty table."""

import re
from collections import Counter

import pytest

import corpus_pipeline as P
from seqloom.llm import decontaminate

SF = "/root/testdata/sf0.001"


def text(k, n=60):
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    near = text(1).rsplit(" ", 1)[0] + " other"
    rows = [(1, text(1), "en", "s", 5), (1, text(2), None, None, None), (None, text(3), "de", "s", 7), (None, None, None, None, None), (4, "", "en", "s", 0), (5, " \n ", "en", None, 1)]
    rows += [(6, text(1), "en", "s", 5), (7, near, "en", "s", 5), (7, near, "en", "s", 5), (8, text(8, 4000), "en", "t", 9)]
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int").repartition(3)


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("n", range(5))
def test_stage_on_an_empty_table(spark, docs, n):
    got = P.STAGES[n][1](spark, docs.filter("false"), SF)
    assert got.count() == 0 and (n == 4 or got.columns == P.COLUMNS)


def test_quality_keeps_rows_as_they_are(spark, docs):
    got = P.quality_rules(spark, docs, SF)
    assert got.columns == P.COLUMNS and rows_of(got) == Counter((r.doc_id, r.text) for r in docs.collect() if r.text and len(r.text.split()) >= 50)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    want = Counter([(1, text(1)), (1, text(2)), (None, text(3)), (None, None), (4, ""), (5, " \n "), (8, text(8, 4000))])
    got = P.near_duplicates(spark, docs, SF)
    assert got.columns == P.COLUMNS and rows_of(got) == want


def test_decontamination_leaves_clean_rows(spark, docs):
    got = P.decontamination(spark, docs, SF)
    assert got.columns == P.COLUMNS and rows_of(got) == rows_of(docs)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text IS NOT NULL").orderBy("item_id").head().text
    dirty = spark.createDataFrame([(1, text(5) + " " + item + " " + text(6), "en", "s", 1), (2, item, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in P.decontamination(spark, dirty, SF).collect()}
    assert set(left) == {1} and re.findall(r"\w+", left[1]) == (text(5) + " " + text(6)).split()


def test_mixing_draws_by_id_and_source(spark, docs):
    got = P.mixing_to_weights(spark, docs, SF)
    assert got.columns == P.COLUMNS and set(rows_of(got)) <= set(rows_of(docs))
    assert rows_of(got) == rows_of(P.mixing_to_weights(spark, docs.repartition(7), SF))


def test_token_output_has_every_row(spark, docs):
    got = P.token_output(spark, docs, SF).orderBy("start").collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens


def test_large_benchmarks_are_refused(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 10)
    with pytest.raises(ValueError):
        P.decontamination(spark, docs, SF)
