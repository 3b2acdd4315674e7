"""Repeated phrases, spelling variants and the filter audit against SQL and brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations, permutations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowrisk.llm import audit, phrases, variants
from flowrisk.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import prose


# repeated phrases

def without_phrases(texts, width):
    """Kept words of each text, by a count of all windows."""
    words = [brute.WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i:i + width])] > 1 for j in range(i, i + width)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return words, out


@pytest.mark.parametrize("width,gram,hot,block,few", [(35, 8, 4096, 1 << 20, 300), (12, 4, 2, 1 << 20, 40),
                                                      (12, 12, 4096, 30, 3), (9, 2, 1, 25, 40), (5, 1, 3, 1 << 20, 2)])
def test_phrases_of_made_up_texts(spark, monkeypatch, width, gram, hot, block, few):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "TEXT_BYTES", 8 * block)
    r = random.Random(width * hot)
    pool = [prose(k, r.randint(1, 2 * width), few) for k in range(12)] + ["one common line that many of the texts have", "x " * 40]
    texts = [" ".join(r.choice(pool) if r.random() < .7 else prose(i * 90 + k, 5, few) for k in range(r.randint(0, 7)))
             for i in range(90)]
    texts += [None, "", " \n\t", texts[0], texts[0], "a b " * 3 * width, "a " * (4 * width)]
    texts += [" ".join("w" * k for k in range(60, 60 + 2 * width)) + end for end in ("", " é", "\x0b")]
    words, kept = without_phrases(texts, width)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = phrases.drop_phrases(df, width=width, gram=gram, hot=hot, parts=5).collect()
    assert len(rows) == len(texts)
    for x in rows:
        i = x["doc_id"]
        assert (x["kept"], x["n_words"], x["n_removed"]) == (" ".join(kept[i]), len(words[i]), len(words[i]) - len(kept[i])), i


def test_phrases_of_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumn("n_words", F.lit("old")).withColumn("_part", F.lit(1)).withColumn("digit", F.lit("d"))
    rows = phrases.drop_phrases(docs, width=20).collect()
    texts = [r["text"] for r in odd_docs.collect()]
    _, kept = without_phrases(texts, 20)
    assert sorted(r["kept"] for r in rows) == sorted(" ".join(k) for k in kept)
    assert set(rows[0].asDict()) == (set(docs.columns) - {"text"}) | {"kept", "n_words", "n_removed"}
    assert phrases.drop_phrases(no_docs).collect() == []


def test_automaton_finds_all_and_only_passages():
    r = random.Random(5)
    for _ in range(40):
        contents = list({b" ".join(r.choice([b"a", b"b"]) for _ in range(r.randint(6, 14))) for _ in range(12)})
        copies = np.array([r.randint(1, 2) for _ in contents], float)
        digits = np.zeros(len(contents), np.int64)
        coded, passages = phrases.confirmed(contents, digits, copies, 6)
        seen = Counter()
        for c, n in zip(coded, copies):
            for i in range(len(c) - 5):
                seen[c[i:i + 6]] += n
        machine = phrases.automaton(passages) if passages else None
        for c in coded:
            gone = {j for i in range(len(c) - 5) if seen[c[i:i + 6]] > 1 for j in range(i, i + 6)}
            spans = phrases.occurrences(machine, c) if machine else []
            assert {j for a, b in spans for j in range(a, b)} == gone
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


# spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def forms(count, ratio):
    near = defaultdict(list)
    for a, b in combinations(count, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= ratio * n else None
    out = {}
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], count[form[w]] if form[w] else None, root)
    return out


@pytest.mark.parametrize("symbols,most_bits", [(16, 28), (2, 28), (3, 6)])
def test_forms_match_brute_force(spark, monkeypatch, symbols, most_bits):
    monkeypatch.setattr(variants, "MOST_BITS", most_bits)
    r = random.Random(symbols)
    count = {}
    for _ in range(700):
        w = "".join(r.choice("abßé\U0001f600") for _ in range(r.randint(1, 6)))
        count[w] = int(10 ** r.uniform(0, 6))
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    got = {x["word"]: tuple(x[c] for c in ("n", "n_near", "form", "form_n", "root"))
           for x in variants.spelling_forms(words, ratio=10, symbols=symbols).collect()}
    assert got == forms(count, 10)
    empty = variants.spelling_forms(words.limit(0))
    assert empty.collect() == [] and empty.columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_long_chains_of_forms(spark):
    count = {"a" * k: 10 ** k for k in range(1, 17)}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert {x["root"] for x in variants.spelling_forms(words).collect()} == {"a" * 16}


def test_runs_of_odd_rows(odd_docs, no_docs, odd_texts):
    docs = odd_docs.withColumn("word", F.lit("w")).withColumn("n", F.lit("x"))
    expected = Counter()
    import re
    for x in odd_docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", x["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if x['doc_id'] is None else x['doc_id']}:{run}".encode())
            if h % 3 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 4:
                expected[run] += 1
    got = variants.count_runs(docs, least=4, every=3).collect()
    assert {x["word"]: x["n"] for x in got} == expected and len(got) == len(expected)
    assert variants.count_runs(no_docs).collect() == []


# filter audit

def test_carry_save_counts():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 5, 1000, 4099):
        words = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert audit.positional_counts(words).tolist() == [int((words >> np.uint32(i) & 1).sum()) for i in range(32)]


def test_survival_words():
    for f, w in enumerate(audit.survival_words(np.arange(32), 5).tolist()):
        assert [w >> s & 1 for s in range(32)] == [int(f & s == 0) for s in range(32)]


def audited(rows, good, toxic):
    """rows: (key, text, part); every order run step by step."""
    fails = []
    for key, text, part in rows:
        t = text or ""
        words = brute.WORD.findall(t)
        first = any(k is not None and key is not None and k < key and (x or "") == t for k, x, _ in rows)
        fails.append((part or "", key, {c for c, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), first)) if bad}))
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in fails}:
        own = [(k, f) for p, k, f in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                shapley[part, c] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(c in f for _, f in own) - len(gone),
                                          sum(f == {c} for _, f in own), sum(k in good for k, _ in gone),
                                          sum(k in toxic for k, _ in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("part", F.lit("p")).withColumn("failed", F.lit(3)).withColumn("quality", F.lit(1))
    docs = docs.union(docs.where("doc_id < 9").withColumn("doc_id", F.col("doc_id") + 100).withColumn("text", F.upper("text")))
    labels = spark.createDataFrame([(0, 1, 0, "x"), (0, 0, 0, "x"), (6, 1, 1, "y"), (7, 0, 1, None), (103, 1, None, "z"), (None, 1, 1, "n"),
                                    (999, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")
    rows = [(x["doc_id"], x["text"], x["lang"]) for x in docs.collect()]
    expected = audited(rows, {0, 6, 103}, {6, 7})
    got = audit.audit_filters(docs, labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in names) for x in got} == expected
    assert len(got) == len(expected)
    assert audit.audit_filters(no_docs, labels).collect() == []
    assert len(audit.audit_filters(odd_docs, labels.limit(0)).collect()) == 1200


def test_kept_hash_is_of_the_kept_words(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(texts)
    _, kept = without_phrases([texts[i] for i in ids], 35)
    expected = {i: hashlib.sha256(" ".join(k).encode()).hexdigest() for i, k in zip(ids, kept)}
    assert {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op11_phrase_automata"](spark, SMALL).collect()} == expected
