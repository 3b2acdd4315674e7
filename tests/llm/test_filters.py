"""Quality rules, license scans and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowrisk.llm import licenses, quality
from flowrisk.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF, SMALL
from tests.llm import brute
from tests.llm.conftest import prose
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


def test_statistics_of_odd_rows(odd_docs, no_docs):
    got = quality.add_statistics(odd_docs.withColumn("t", F.col("text")), "t").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        n, chars, symbols, lines, repeated = brute.quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) \
            == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
    assert quality.apply_rules(no_docs).collect() == []
    out = quality.apply_rules(odd_docs)
    assert out.count() == odd_docs.count() and out.where("kept and base_failed").count() == 0


def test_statistics_of_random_texts(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(["a", "b", "c ", " ", "\n", "\t", "#", "é", "\x0b", "　"]) for _ in range(r.randint(0, 200)))
             for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality.add_statistics(df).collect():
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) \
            == brute.quality(texts[row["doc_id"]])


def test_buckets_are_monotone_and_invert(spark):
    rows = spark.range(0, 5000).select(F.col("id").alias("v"), quality.bucket(F.col("id")).alias("b"))
    rows = rows.withColumn("low", quality.least_of(F.col("b"))).orderBy("v").collect()
    for a, b in zip(rows, rows[1:]):
        assert a["b"] <= b["b"] <= a["b"] + 1
    assert all(r["low"] <= r["v"] <= r["low"] * 9 / 8 + 1 for r in rows)
    assert all(r["low"] == r["v"] for r in rows[:16])


def test_thresholds_follow_their_source(spark):
    """What is common in one source is an outlier in another; clean texts stay."""
    def table(i, cell):
        return " ".join(w + (" |" if k % 3 == 0 else "") for k, w in enumerate(prose(i, cell).split()))
    rows = [(i, prose(i, 80), "en", "plain") for i in range(300)]
    rows += [(1000 + i, table(i, 80), "en", "tables") for i in range(300)]
    rows += [(2000 + i, table(5000 + i, 80), "en", "plain") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.apply_rules(df).where("kept").collect()}
    assert kept == {*range(300), *range(1000, 1300)}


def test_license_forms(spark):
    mit = licenses.TEXTS[0][1]
    body = mit.split("\n", 2)[2]
    rows = [(0, mit), (1, "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + body.upper().replace(",", " , ")),
            (2, "© 2021 X\n" + mit.replace("License", "Licence")), (3, body + " and more"), (4, None), (5, ""),
            (6, "first\n  ## licensed under the Apache Licence - version 2.0\nlast\nReleased under the MIT License."),
            (7, "SPDX-License-Identifier: MIT"), (8, "Copyright by Licence"), (8, "Copyright by Licence")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_license", F.lit("other"))
    got = sorted(licenses.license_scan(df).collect(), key=lambda r: r["doc_id"])
    assert [r["text_license"] for r in got] == ["MIT", "MIT", "MIT", None, None, None, None, "MIT", None, None]
    assert (got[6]["line_licenses"], got[6]["n_license_lines"]) == ("Apache-2.0,MIT", 2)
    assert got[4]["text_digest"] == got[5]["text_digest"] == got[8]["text_digest"]
    assert licenses.license_scan(df.limit(0)).collect() == []


def test_license_scan_of_odd_rows(odd_docs):
    assert licenses.license_scan(odd_docs).count() == odd_docs.count()


def _stages(spark, docs, sf_dir):
    out = []
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf_dir)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append((docs.columns, rows))
    return out


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first, lines, near, cut, packed = _stages(spark, docs, SMALL)
    assert all(columns == docs.columns for columns, _ in (first, lines, near, cut))
    kept = {r["doc_id"] for r in quality.apply_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in first[1]} == kept
    from flowrisk.llm.templates import _hash
    texts = brute.template_lines(sorted((r["doc_id"], r["text"]) for r in first[1]), 10,
                                 order=lambda t: _hash(" ".join(t)))
    assert {r["doc_id"]: r["text"] for r in lines[1]} == texts
    ids = sorted(texts)
    label = brute.simhash_groups([brute.simhash(texts[i]) for i in ids])
    stay = sorted({ids[a] for a in label})
    assert sorted(r["doc_id"] for r in near[1]) == stay
    expected = brute.without_repeats([texts[i].encode() for i in stay], 100)
    expected = {i: k.decode("utf-8", "ignore") for i, (k, _) in zip(stay, expected)}
    assert {r["doc_id"]: r["text"] for r in cut[1]} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in cut[1])
    assert {r["doc_id"] for r in packed[1]} == set(stay)
    ends = {}
    for r in packed[1]:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 and min(p)[0] == 0 for p in ends.values())
    whole = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "length", "ids_crc32").collect()]
    assert sorted(whole) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed[1])


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs.select(columns), no_docs.select(columns)):
        out = _stages(spark, docs, SMALL)
        assert all(c == columns for c, _ in out[:-1])
    wide = odd_docs  # more columns, with clashing names
    assert all(c == wide.columns for c, _ in _stages(spark, wide, SMALL)[:-1])


def test_sources_of_one_language_differ(spark):
    """One text passes in a source whose sketch has such texts, and not in its neighbour."""
    def spaced(i, every):
        return " ".join(w + (" $" if every and k % every == 0 else "") for k, w in enumerate(prose(i, 90).split()))
    rows = [(i, spaced(i, 0), "en", "a") for i in range(400)] + [(1000 + i, spaced(i, 5 + i % 5), "en", "b") for i in range(400)]
    rows += [(5000, spaced(7000, 4), "en", "a"), (5001, spaced(7000, 4), "en", "b")]
    out = quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r["doc_id"]: r["kept"] for r in out.where("doc_id >= 5000").collect()} == {5000: False, 5001: True}


def test_thresholds_behave_alike_at_every_size(spark, monkeypatch):
    """Twenty rows and twenty thousand of one make-up give one verdict; the join's form changes nothing."""
    base = [(prose(i, 80 + i % 9) + " $" * (i % 3), "en", f"s{i % 2}") for i in range(40)]
    few = spark.createDataFrame([(i, *r) for i, r in enumerate(base)], "doc_id long, text string, lang string, source string")
    many = few.crossJoin(spark.range(100)).drop("id")
    verdict = lambda df: {(r["doc_id"], r["kept"]) for r in quality.apply_rules(df).select("doc_id", "kept").distinct().collect()}
    assert verdict(few) == verdict(many)
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert verdict(few) == verdict(many)


def test_two_stage_results_live_at_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = corpus_pipeline.line_dedup(spark, docs.where("doc_id < 100"), SMALL)
    b = corpus_pipeline.line_dedup(spark, docs.where("doc_id >= 100"), SMALL)
    assert a.count() + b.count() == docs.count()
    assert a.select("text").collect() and b.select("text").collect()
