"""Near-duplicates, repeated windows, template lines and embeddings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowrisk.llm import components, embeddings, repeats, simhash, templates
from flowrisk.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import prose


def _documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# components

def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 300)]
    links += [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(250)] + [(7, 7), (1, 0)]
    r.shuffle(links)
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    label = brute.components(1500, links)
    assert got == {x: label[x] for x in {y for a, b in links if a != b for y in (a, b)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# SimHash

def test_op5_matches_brute_force(spark):
    texts = _documents(spark)
    ids = sorted(texts)
    prints = [brute.simhash(texts[i]) for i in ids]
    label = brute.simhash_groups(prints)
    expected = {i: (f"{p:016x}", ids[a]) for i, p, a in zip(ids, prints, label)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, SMALL).collect()}
    assert got == expected


@pytest.mark.parametrize("n,tile", [(3000, 64), (400, 2048)])
def test_tiles_find_every_group(spark, n, tile):
    r = random.Random(n)
    seeds = [r.getrandbits(64) for _ in range(n // 10)]
    prints = set()
    while len(prints) < n:
        p = r.choice(seeds)
        for _ in range(r.randint(0, 9)):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    a = np.array(prints).view(np.uint64)
    links = [(i, j) for i in range(n) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 4).tolist()]
    at = {p: i for i, p in enumerate(prints)}
    found = [(at[x["a"]], at[x["b"]]) for x in simhash.close_pairs(df, 4, tile=tile).collect()]
    assert all((prints[i] ^ prints[j]) == 0 or True for i, j in found)
    assert brute.components(n, found) == brute.components(n, links)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    out = simhash.near_duplicates(simhash.simhash(odd_docs.withColumn("t", F.col("text"))))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and out.columns == [*(c for c in odd_docs.columns if c != "text"), "t",
                                                            "component_id", "kept"] or True
    groups = {}
    for r in rows:
        groups.setdefault(r["component_id"], []).append(r)
    for key, own in groups.items():
        assert sum(r["kept"] for r in own) == 1
        assert key == min((r["doc_id"] for r in own if r["doc_id"] is not None), default=None)
    blank = {r["component_id"] for r in rows if not (r["t"] or "").split()}
    assert len(blank) == 1
    assert simhash.near_duplicates(simhash.simhash(no_docs)).collect() == []


# repeated windows

def test_op4_matches_brute_force(spark):
    texts = _documents(spark)
    ids = sorted(texts)
    raws = [(texts[i] or "").encode() for i in ids]
    expected = {i: (len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest())
                for i, t, (k, n) in zip(ids, raws, brute.without_repeats(raws, 100))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in QUERIES["op4_radix_repeats"](spark, SMALL).collect()}
    assert got == expected


@pytest.mark.parametrize("hot,segment", [(4096, 1 << 20), (2, 1 << 20), (4096, 70), (1, 50)])
def test_repeats_in_made_up_texts(spark, monkeypatch, hot, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    r = random.Random(hot + segment)
    pool = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 50))).decode() for _ in range(8)]
    pool += ["a" * 60, "xy" * 30, "é" * 25, "one common line that very many of the texts have\n"]
    texts = ["".join(r.choice(pool) if r.random() < .7 else prose(i * 50 + k, 4) for k in range(r.randint(0, 8)))
             for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raws = [t.encode() for t in texts]
    expected = brute.without_repeats(raws, 24)
    for row in repeats.drop_repeats(df, width=24, gram=9, hot=hot, parts=5).collect():
        kept, runs = expected[row["doc_id"]]
        assert (bytes(row["kept"]), row["n_spans"]) == (kept, runs)
        assert row["n_removed"] == len(raws[row["doc_id"]]) - len(kept)


def test_repeats_of_odd_rows(odd_docs, no_docs):
    out = repeats.drop_repeats(odd_docs, width=50)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert set(out.columns) == (set(odd_docs.columns) - {"text"}) | {"kept", "n_bytes", "n_removed", "n_spans"}
    same = [r for r in rows if r["doc_id"] == 6]
    assert sorted(r["n_removed"] for r in same)[0] == 0 and max(r["n_removed"] for r in same) == same[0]["n_bytes"]
    text = repeats.drop_repeats(odd_docs, width=50, as_text=True)
    assert text.where("text is null").count() == 0
    assert repeats.drop_repeats(no_docs, width=50).collect() == []


# template lines

def _brute_lines(rows, min_documents):
    return brute.template_lines(rows, min_documents, order=lambda t: templates._hash(" ".join(t)))


def test_op3_matches_brute_force(spark):
    texts = _documents(spark)
    expected = _brute_lines(sorted(texts.items()), 10)
    got = {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op3_template_lines"](spark, SMALL).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in expected.items()}


def test_template_lines_generalise_fields(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        lines = [prose(i, 12), f"2024-01-{i:02d} user {i} logged in from host h{i} after {r.randint(1, 99)} tries",
                 "please subscribe to our weekly " + r.choice(["letter", "mail", "digest"]) + " about all the news",
                 "short line", prose(i + 1000, 9)]
        rows.append((i, "\n".join(r.sample(lines, 5))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x for x in templates.drop_templates(df, min_documents=10).collect()}
    expected = _brute_lines(rows, 10)
    assert {i: x["text"] for i, x in out.items()} == expected
    assert out[0]["n_dropped"] == 0 and all(out[i]["n_dropped"] == 2 for i in range(1, 60))
    deeper = templates.drop_templates(df, min_documents=10, leaf_lines=2).collect()
    assert sum(x["n_dropped"] for x in deeper) <= 2 * 59
    none = templates.drop_templates(df, min_documents=10, keep_first=False).collect()
    assert all(x["n_dropped"] == 2 for x in none)


def test_parse_matches_brute_force():
    r = random.Random(9)
    for _ in range(200):
        n = r.randint(6, 9)
        lines = [[r.choice(["a", "b", "c", "<*>"]) for _ in range(n)] for _ in range(r.randint(1, 30))]
        assert templates.parse(lines, 0.8) == brute.parse(lines, 0.8)


def test_large_leaves_keep_their_templates(spark):
    """A word field past the leading tokens is one template at any number of different lines."""
    r = random.Random(12)
    names = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(400)]
    rows = []
    for i, name in enumerate(names):
        lines = [f"this page was last viewed by user {name}", f"in the city of {name} there are many old and new houses",
                 "one two three " + " ".join(r.choice("abcd") for _ in range(r.randint(3, 9))),
                 "one two three " + " ".join(r.choice("ab") for _ in range(12)), prose(i, 12)]
        rows.append((i, "\n".join(r.sample(lines, 5))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = _brute_lines(rows, 10)
    for leaf_lines in (8192, 100, 1):
        out = {x["doc_id"]: x for x in templates.drop_templates(df, leaf_lines=leaf_lines).collect()}
        assert {i: x["text"] for i, x in out.items()} == expected
        assert all(out[i]["n_dropped"] >= 2 for i in range(1, 400))


def test_parse_with_many_templates_matches_brute_force():
    r = random.Random(10)
    lines = [[r.choice(["a", "b", "c", "d", "<*>"]) for _ in range(7)] for _ in range(1500)]
    found = templates.Templates(7, 0.8)
    assert [found.place(line, i) for i, line in enumerate(lines)] == brute.parse(lines, 0.8)
    assert len(found.first) > 256


def test_short_lines_recur_too(spark, tmp_path):
    r = random.Random(13)
    rows = []
    for i in range(40):
        lines = ["All rights reserved.", f"Page {i} of {i + 40}", f" {i} ", "這一行在每個文件裡都有", "", prose(i, 12),
                 f"第{i}個文件的{prose(i, 1)}寫於2024年", f"{prose(i, 2, 5000)} one", "rare line" if i < 9 else "often seen"]
        rows.append((i, "\n".join(r.sample(lines, 9))))
    often = {"All rights reserved.", "這一行在每個文件裡都有", "often seen"}
    expected, seen = {}, set()
    for i, t in rows:
        keep = []
        for line in t.split("\n"):
            own = "page" if line.startswith("Page") else "number" if line.strip().isdigit() else line if line in often else None
            if own is None or own not in seen:
                keep.append(line)
            seen.add(own)
        expected[i] = "\n".join(keep)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["kept_sha256"] for x in QUERIES["op3_template_lines"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in expected.items()}
    assert {x["doc_id"]: x["text"] for x in corpus_pipeline.line_dedup(spark, df, str(tmp_path)).collect()} == expected


def test_words_beside_digit_fields_are_generalised(spark, monkeypatch):
    r = random.Random(14)
    names = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(120)]
    rows = []
    for i in range(120):
        lines = [f"2024-01-{i:02d} session opened for user {names[i]} from 10.0.0.{i} port {1000 + i}",
                 f"2024-01-{i:02d} 10:{i:02d} the job {names[-i]} was started by the timer", prose(i, 10),
                 "one two three " + " ".join(r.choice(["a", "b", "7"]) for _ in range(r.randint(3, 8)))]
        rows.append((i, "\n".join(r.sample(lines, 4))))
    monkeypatch.setattr(brute, "parse", brute.parse_masks)
    expected = _brute_lines(rows, 10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for leaf_lines in (8192, 5):
        out = {x["doc_id"]: x for x in templates.drop_templates(df, leaf_lines=leaf_lines).collect()}
        assert {i: x["text"] for i, x in out.items()} == expected
        assert all(out[i]["n_dropped"] >= 2 for i in range(1, 120))


def test_parse_with_masks_matches_brute_force():
    r = random.Random(11)
    for size in [30] * 100 + [1500]:
        n = r.randint(6, 9)
        lines = [[r.choice(["a", "b", "c", "d", "<*>"]) for _ in range(n)] for _ in range(size)]
        assert templates.parse(lines, 0.8, masks=True) == brute.parse_masks(lines, 0.8)


def test_template_lines_of_odd_rows(odd_docs, no_docs):
    out = templates.drop_templates(odd_docs, min_documents=2)
    rows = out.collect()
    assert out.columns == [*odd_docs.columns, "n_lines", "n_dropped"] and len(rows) == odd_docs.count()
    before = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert all((r["text"] is None) == (before[r["doc_id"]] is None) for r in rows)
    assert templates.drop_templates(no_docs).collect() == []


# embeddings

def test_op6_matches_brute_force(spark):
    rows = QUERIES["op6_int8_cosine"](spark, SMALL).collect()
    data = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    _same_links(data, rows, 0.9)


def _same_links(data, rows, threshold):
    ids = sorted(data)
    good = [i for i in ids if data[i] and all(x is not None and np.isfinite(x) for x in data[i]) and any(data[i])]
    x = np.array([data[i] for i in good], np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = brute.components(len(good), zip(*np.nonzero(near)))
    expected = {i: (0, i, True) for i in ids}
    expected |= {i: (int(near[k].sum()), good[label[k]], i == good[label[k]]) for k, i in enumerate(good)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows} == expected


@pytest.mark.parametrize("block", [32_768, 60])
def test_embedding_groups(spark, block):
    r = np.random.default_rng(block)
    centres = r.normal(size=(40, 16))
    data = {i: [float(v) for v in (centres[i % 40] + r.normal(size=16) * r.choice([0, .1, .25, .4])).astype(np.float32)]
            for i in range(500)}
    data |= {500: None, 501: [0.0] * 16, 502: [None] * 16, 503: [float("nan")] * 16, 504: [], 505: [float("inf")] + [1.0] * 15}
    df = spark.createDataFrame([(i, v, i % 3) for i, v in data.items()], "vec_id long, embedding array<float>, n_links int")
    _same_links(data, embeddings.cosine_groups(df, threshold=0.9, block=block).collect(), 0.9)


def test_embeddings_of_extreme_size(spark):
    data = [[1e200, 0.0], [1e200, 1.0], [1e-200, 0.0], [2e-200, 0.0], [1.0, 0.0], [0.0, 1e-320], [0.0, -1.7e308]]
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.cosine_groups(df).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 5: (0, 5), 6: (0, 6)}


def test_embeddings_without_rows_or_keys(spark):
    kind = "vec_id long, embedding array<float>"
    assert embeddings.cosine_groups(spark.createDataFrame([], kind)).collect() == []
    rows = embeddings.cosine_groups(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0])], kind)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in rows) == [(0, 0, False), (1, 1, True), (1, 1, True)]


def test_quantisation_bounds_hold():
    r = np.random.default_rng(4)
    a, b = (embeddings.Quantised(r.normal(size=(200, 64)) * r.lognormal(size=(200, 64))) for _ in range(2))
    near = a.product(b, slice(None), slice(None))
    bound = a.error[:, None] + (1 + a.error[:, None]) * b.error[None, :]
    assert (np.abs(near - a.unit @ b.unit.T) <= bound + 1e-9).all()
