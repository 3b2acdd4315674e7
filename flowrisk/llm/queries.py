"""One query per training-data operator over its whole table, and their SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm import (audit, bpe, counts, embeddings, licenses, packing, phrases, quality, repeats, sharding,
                          simhash, templates, variants)
from flowrisk.llm.common import documents, utf8_size

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


# Texts, words and lines as the statistics see them; sketch buckets in whole numbers.
QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again
  FROM (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
r AS (
  SELECT doc_id, sum(least(3, i - before)) AS n_repeat_words
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 3) AS before
        FROM g WHERE again) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols * 1000 // greatest(word_chars, 1) AS v_symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS v_lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS v_words, word_chars * 100 // greatest(n_words, 1) AS v_length
  FROM s),
u AS (
  SELECT lang, source, rule, v FROM b, LATERAL (VALUES ('symbols', v_symbols), ('lines', v_lines),
    ('words', v_words), ('length', v_length)) x(rule, v) WHERE NOT base_failed),
k AS (
  SELECT *, CASE WHEN v < 8 THEN v ELSE (1 << (length(bin(v)) - 4)) * (v // (1 << (length(bin(v)) - 4))) END AS low
  FROM u),
h AS (SELECT lang, source, rule, low, count(*) AS n FROM k GROUP BY ALL),
ha AS (SELECT rule, low, 1000 * sum(n) AS w FROM h GROUP BY ALL),
hl AS (
  SELECT lang, rule, low, sum(w) AS w FROM (
    SELECT lang, rule, low, 1000 * n AS w FROM h
    UNION ALL
    SELECT g.lang, g.rule, low, 10000 * w // sum(w) OVER (PARTITION BY g.lang, g.rule)
    FROM (SELECT DISTINCT lang, rule FROM h) g JOIN ha ON g.rule = ha.rule)
  GROUP BY ALL),
hs AS (
  SELECT lang, source, rule, low, sum(w) AS w FROM (
    SELECT lang, source, rule, low, 1000 * n AS w FROM h
    UNION ALL
    SELECT g.lang, g.source, g.rule, low, 10000 * w // sum(w) OVER (PARTITION BY g.lang, g.source, g.rule)
    FROM (SELECT DISTINCT lang, source, rule FROM h) g
    JOIN hl ON g.lang IS NOT DISTINCT FROM hl.lang AND g.rule = hl.rule)
  GROUP BY ALL),
q AS (
  SELECT s.lang, s.source, s.rule, any_value(m.least) AS least, min(low) FILTER (4 * seen >= total) AS q1,
         min(low) FILTER (2 * seen >= total) AS q2, min(low) FILTER (4 * seen >= 3 * total) AS q3,
         min(low) FILTER (100 * seen >= m.pct * total) AS tail
  FROM (SELECT *, sum(w) OVER (PARTITION BY lang, source, rule ORDER BY low) AS seen,
               sum(w) OVER (PARTITION BY lang, source, rule) AS total FROM hs) s
  JOIN (VALUES ('symbols', 95, 10), ('lines', 99, 20), ('words', 99, 20), ('length', 95, 20)) m(rule, pct, least)
    ON s.rule = m.rule
  GROUP BY s.lang, s.source, s.rule),
f AS (
  SELECT * REPLACE (CASE WHEN q3 < 16 THEN q3 ELSE q3 + (1 << (length(bin(q3)) - 4)) - 1 END AS q3),
         3 * greatest(q3 - q1, (tail - q2) // 2, least) AS reach
  FROM q),
c AS (
  SELECT lang, source,
         max(q3 + reach) FILTER (rule = 'symbols') AS symbols_high, max(q3 + reach) FILTER (rule = 'lines') AS lines_high,
         max(q3 + reach) FILTER (rule = 'words') AS words_high, max(q3 + reach) FILTER (rule = 'length') AS length_high,
         max(q1 - reach) FILTER (rule = 'length') AS length_low
  FROM f GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND v_symbols <= symbols_high AND v_lines <= lines_high AND v_words <= words_high
                AND v_length <= length_high AND v_length >= length_low, false) AS kept
FROM b LEFT JOIN c ON b.lang IS NOT DISTINCT FROM c.lang AND b.source IS NOT DISTINCT FROM c.source
"""

# Every window as a string; a word goes if one of the windows that hold it is found twice.
PHRASES_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
m AS (SELECT md5(gram) AS h FROM g GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, i FROM g WHERE md5(gram) IN (SELECT h FROM m)),
p AS (
  SELECT d.doc_id, d.i, w, max(s.i) OVER (PARTITION BY d.doc_id ORDER BY d.i) AS last_start
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) d
  LEFT JOIN s ON d.doc_id = s.doc_id AND d.i = s.i),
k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (i - last_start < 35) AS n_removed,
         string_agg(w, ' ' ORDER BY i) FILTER (coalesce(i - last_start >= 35, true)) AS kept
  FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

# crc32 byte by byte from its polynomial's table; near words are equal once one place is left out.
VARIANTS_SQL = r"""
WITH RECURSIVE bits(byte, v, step) AS (
  SELECT range, range::UBIGINT, 0 FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY byte) AS tab FROM bits WHERE step = 8),
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
h AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'),
      lambda x: ('0x' || x)::UBIGINT)), lambda c, x: xor(c >> 8, tab[(1 + (xor(c, x) & 255))::BIGINT])), 4294967295::UBIGINT) AS h
  FROM r, crc),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
              ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
v AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS part
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n
  FROM v a JOIN v b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT v.word, w.word, w.n FROM v JOIN w ON v.part = w.word
  UNION
  SELECT w.word, v.word, v.n FROM v JOIN w ON v.part = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
forms AS (
  SELECT f.word, f.n, f.n_near, f.form_n, min(near.near) AS form
  FROM f LEFT JOIN near ON f.word = near.word AND near.near_n = f.form_n GROUP BY ALL),
chain(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, chain.root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN chain ON forms.word = chain.word
JOIN forms o ON chain.root = o.word AND o.form IS NULL
"""

AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
l AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
          100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda i: chr((64 + i)::INT)), '') AS filter_order,
             unnest(range(1, 6)) AS step FROM o),
z AS (
  SELECT part, filter_order, step, o[step] AS own, n, good, toxic, fails[o[step]] AS fail,
         len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone,
         len(list_filter(fails, lambda y: y)) AS many
  FROM s, c),
t AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept,
         coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed, coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant,
         coalesce(sum(n) FILTER (fail AND many = 1), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND fail AND good), 0) AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND fail AND toxic), 0) AS toxic_lost
  FROM z GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM t
"""


def register(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn
    return deco


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary file is."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register()
def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0-23 of nearly equal bytes, in the order (hash of the text, doc_id)."""
    out = sharding.histogram_shards(documents(spark, sf_dir).select("doc_id", "text"), 24, group=F.col("text"),
                                    tie="doc_id", weight=utf8_size("text") + 8)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", F.col("weight").alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register(licenses.oracle_sql())
def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licenses that a whole text, or a whole line of it, is in canonical form."""
    return licenses.license_scan(documents(spark, sf_dir))


@register()
def op3_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines whose template recurs in ten or more documents."""
    out = templates.drop_templates(documents(spark, sf_dir).select("doc_id", "text"), min_documents=10,
                                   short_lines=True)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@register()
def op4_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the 100-byte strings that also start earlier."""
    out = repeats.drop_repeats(documents(spark, sf_dir).select("doc_id", "text"), width=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 4-word shingles, and the groups that 4 or fewer differing bits link."""
    prints = simhash.simhash(documents(spark, sf_dir).select("doc_id", "text"), shingle=4, seed=42)
    out = simhash.near_duplicates(prints, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@register()
def op6_int8_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked by a cosine of 0.9 or more."""
    return embeddings.cosine_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


@register()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the byte-level ranks, and what they decode to."""
    import public_tokenizers
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    ids = bpe.bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    ids = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                     F.sha2("ids", 256).alias("ids_sha256"), "ids")
    out = bpe.bpe_decode(ids, ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@register()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text; over the limit beyond 1,024 tokens."""
    return counts.token_counts(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


@register(QUALITY_SQL)
def op9_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics of every text, and the verdict of its language and source's thresholds."""
    out = quality.apply_rules(documents(spark, sf_dir), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept")


@register()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2,048 tokens."""
    pieces = packing.token_pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2048)
    return packing.pack(pieces, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register(PHRASES_SQL)
def op11_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the 35-word windows that also start anywhere else."""
    out = phrases.drop_phrases(documents(spark, sf_dir).select("doc_id", "text"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register(VARIANTS_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters or more, their near words and the forms that these lead to."""
    words = variants.count_runs(documents(spark, sf_dir), least=7, every=31).where("n >= 2")
    return variants.spelling_forms(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


@register(AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do at every step of all their orders, per language."""
    return audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
