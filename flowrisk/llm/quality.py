"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every text gets plain statistics (words, symbols, repeated lines and words).  For each rule
a log-linear histogram sketch per language and source counts the values; sketches merge by
adding counts, so they are an ordinary partial aggregation, and a quantile read from one is
exact up to the bucket's width (an eighth of the value).  A group's sketch is blended with its
language's, and that with the corpus', by added counts: a few rows' weight of the wider sketch,
at every size of the group.  The rules' cutoffs are fences around the quartiles of the row's own
language and source, their reach a spread that the sketch shows; joined back for the filter.

DataFrame functions only.  Scale: one pass over the texts, whose narrow statistics are staged;
where the text is asked for as well the texts are read a second time, which costs less disk
than to write them once more.  The sketch has a bounded number of buckets a group,
and a hot source is pre-aggregated before it is shuffled.  The thresholds, a row a group, are
counted and broadcast where they are few, so that no text moves for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.llm.common import SPACES
from flowrisk.session import stage

#: Rule -> (value of a row as a whole number, percent at which its tail is read, least spread
#: that can be told apart, fence below as well).
RULES: dict[str, tuple[str, int, int, bool]] = {
    "symbols": ("n_symbols * 1000 div greatest(word_chars, 1)", 95, 10, False),
    "lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 99, 20, False),
    "words": ("n_repeat_words * 1000 div greatest(n_words, 1)", 99, 20, False),
    "length": ("word_chars * 100 div greatest(n_words, 1)", 95, 20, True),
}
#: Spreads between quartile and fence; rows that the wider sketch counts for in a blend; parts of a row.
SPREADS, PRIOR_ROWS, UNIT = 3, 10, 1000
#: Groups whose thresholds are broadcast (about 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 50_000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def add_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus the columns of ``STATISTICS`` and ``base_failed``; null texts have no words.

    Equality of three-word windows is judged by 64-bit hashes within one text.
    """
    rest = [c for c in df.columns if c not in (*STATISTICS, "base_failed")]
    blank = f"[{SPACES}]+"
    out = df.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    out = out.select(*rest, "_t", F.btrim("_t", F.lit(SPACES)).alias("_trimmed"))
    out = out.select(*rest, "_t", F.when(F.col("_trimmed") == "", F.array().cast("array<string>"))
                     .otherwise(F.split("_trimmed", blank)).alias("_w"),
                     F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_l"))
    word = lambda i: F.element_at("_w", i)
    windows = F.transform(F.sequence(F.lit(1), F.size("_w") - 2),
                          lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    out = out.select(
        *rest, "_l", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.when(F.size("_w") > 2, windows).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.select(*rest, "n_words", "word_chars", "n_symbols", F.size("_l").cast("long").alias("n_lines"),
                     (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                     F.when(repeated, placed).alias("_s"))
    twins = F.zip_with("_s", F.slice("_s", F.lit(2), F.size("_s")),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
                          lambda acc, i: F.struct((acc["n"] + F.least(i - acc["at"], F.lit(3))).alias("n"), i.alias("at")),
                          lambda acc: acc["n"])
    out = out.select(*rest, *STATISTICS[:-1], F.coalesce(F.when(F.col("_s").isNotNull(), covered), F.lit(0))
                     .cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def bucket(v: Column) -> Column:
    """Log-linear bucket of a whole number from 0: exact up to 15, then eight a doubling."""
    e = F.length(F.bin(v)) - 4
    return F.when(v < 8, v.cast("int")).otherwise((e * 8 + F.floor(v / F.pow(F.lit(2), e))).cast("int"))


def least_of(b: Column) -> Column:
    """The least value of a bucket."""
    e = F.floor(b / 8).cast("int") - 1
    return F.when(b < 16, b.cast("long")).otherwise(((b - e * 8) * F.pow(F.lit(2), e)).cast("long"))


def sketches(df: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable sketches: one count per group, rule and bucket."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.expr(v)).alias("bucket"))
                               for r, (v, *_) in RULES.items()]))
    return (df.select(*groups, each.alias("x")).groupBy(*groups, "x.rule", "x.bucket")
            .agg(F.count("*").alias("rows")))


def blend(own: DataFrame, wider: DataFrame, groups: list[str], shared: list[str]) -> DataFrame:
    """Sketches of ``groups`` with weights ``w``: their own rows, and ``PRIOR_ROWS`` of the wider sketch.

    ``own`` has ``rows``; ``wider`` has weights ``w`` of sketches by ``shared``, a part of ``groups``.
    """
    total = Window.partitionBy(*shared, "rule")
    prior = (wider.withColumn("total", F.sum("w").over(total))
             .select(*[F.col(c).alias(f"_{c}") for c in shared], F.col("rule").alias("_rule"), "bucket",
                     F.expr(f"{PRIOR_ROWS * UNIT} * w div total").alias("w")))
    same = F.col("rule") == F.col("_rule")
    for c in shared:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = own.select(*groups, "rule").distinct().join(prior, same).select(*groups, "rule", "bucket", "w")
    weighed = own.select(*groups, "rule", "bucket", (F.col("rows") * UNIT).alias("w"))
    return weighed.union(known).groupBy(*groups, "rule", "bucket").agg(F.sum("w").alias("w"))


def spreads(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """First and third quartile (least and largest value of their buckets) of every group and
    rule, and the spread that its fences take.

    The spread is the quartiles' distance or half of the tail's from the median, whichever is larger.
    """
    by = Window.partitionBy(*groups, "rule")
    ranked = sketch.withColumn("seen", F.sum("w").over(by.orderBy("bucket"))).withColumn("total", F.sum("w").over(by))
    of_rule = lambda k: F.create_map(*[F.lit(x) for r, v in RULES.items() for x in (r, v[k])])[F.col("rule")]
    at = lambda q: F.min(F.when(F.col("seen") * 100 >= F.col("total") * q, F.col("bucket")))
    read = ranked.groupBy(*groups, "rule").agg(
        least_of(at(25)).alias("q1"), least_of(at(50)).alias("q2"), least_of(at(75)).alias("q3"),
        (least_of(at(75) + 1) - 1).alias("q3_top"), least_of(at(of_rule(1))).alias("tail"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.expr("(tail - q2) div 2"), of_rule(2).cast("long"))
    return read.select(*groups, "rule", "q1", "q3_top", spread.alias("spread"))


def thresholds(sketch: DataFrame, lang: str, source: str) -> DataFrame:
    """One row per (lang, source): the fences ``<rule>_high`` and, for some rules, ``<rule>_low``."""
    keys = [lang, source]
    wide = sketch.groupBy(lang, "rule", "bucket").agg(F.sum("rows").alias("rows"))
    all_ = wide.groupBy("rule", "bucket").agg((F.sum("rows") * UNIT).alias("w"))
    best = spreads(blend(sketch, blend(wide, all_, [lang], []), keys, [lang]), keys)
    reach = SPREADS * F.col("spread")
    best = best.select(*keys, "rule", (F.col("q3_top") + reach).alias("high"), (F.col("q1") - reach).alias("low"))
    one = lambda r, c: F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{r}_{c}")
    return best.groupBy(*keys).agg(*[one(r, "high") for r in RULES],
                                   *[one(r, "low") for r, (*_, below) in RULES.items() if below])


def apply_rules(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
                carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all unless given) plus ``STATISTICS``, ``base_failed`` and ``kept``.

    Null languages and sources are groups of their own.  Rows that fail the base rules take no
    part in the sketches.  Empty in, empty out; repeated rows count each.
    """
    carry = list(df.columns) if carry is None else carry
    carry = [c for c in carry if c not in (*STATISTICS, "base_failed", "kept")]
    used = dict.fromkeys([*carry, text, lang, source])
    stats = add_statistics(df.select(*used), text)
    keep = [c for c in dict.fromkeys([*carry, lang, source])]
    stats = stats.select(*keep, *STATISTICS, "base_failed")
    if text not in keep:
        stats = stage(stats, "quality")
    else:  # a generator, so that the optimizer does not copy the statistics into every rule
        stats = stats.select(*keep, F.inline(F.array(F.struct(*STATISTICS, "base_failed"))))
    sketch = stage(sketches(stats.where("not base_failed"), [lang, source]), "sketches")  # read three times
    cuts = thresholds(sketch, lang, source)
    cuts = stage(cuts.withColumnRenamed(lang, "_lang").withColumnRenamed(source, "_source"), "thresholds")
    if cuts.count() <= BROADCAST_GROUPS:
        cuts = F.broadcast(cuts)
    inside = [F.expr(v) <= F.col(f"{r}_high") for r, (v, *_) in RULES.items()]
    inside += [F.expr(v) >= F.col(f"{r}_low") for r, (v, *_, below) in RULES.items() if below]
    good = ~F.col("base_failed")
    for rule in inside:
        good &= rule
    same = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    return (stats.join(cuts, same, "left")
            .select(*carry, *STATISTICS, "base_failed", F.coalesce(good, F.lit(False)).alias("kept")))
