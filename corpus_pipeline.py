"""The corpus pipeline: five stages over ``documents``, each written and read again.

quality rules -> line dedup -> SimHash near-dedup -> suffix-array dedup -> best-fit packing.
All but the last stage return the columns of ``documents``; a stage's decisions take effect
on the texts and rows that the next one sees, and ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm import packing, quality, repeats, simhash, templates
from flowrisk.llm.queries import vocabulary
from flowrisk.session import drop_tables, stage, staged_tables

#: Tokenizer file and tokens of a packed sequence.
TOKENIZER, CAPACITY = "word_bpe_49k.json", 2048


#: Columns that the stages read; any others travel under names that clash with nothing.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[c if c in OWN else f"_other{i}" for i, c in enumerate(docs.columns)])


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a stage's result, with the length of the text as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_aside(docs).columns).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language and source's thresholds."""
    return _restored(quality.apply_rules(_aside(docs)).where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs (but for its first line)."""
    return _restored(templates.drop_templates(_aside(docs), min_documents=10, short_lines=True), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 4 or fewer bits of the SimHash link: the least doc_id."""
    prints = simhash.simhash(_aside(docs).withColumn("_hashed", F.col("text")), "_hashed", shingle=4, seed=42)
    return _restored(simhash.near_duplicates(prints, radius=4).where("kept"), docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 100-byte strings that also start earlier."""
    return _restored(repeats.drop_repeats(_aside(docs), width=100, as_text=True), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, placed in sequences of at most ``CAPACITY`` tokens."""
    return packing.pack(packing.token_pieces(docs, vocabulary(TOKENIZER), CAPACITY), CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the first can be put in SQL; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table: the packed pieces.

    A stage's own tables, and its input, go once its result is written and read again; what the
    last stage stages stays for the result to read.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        with staged_tables() as spent:
            out = step(spark, docs, sf_dir)
        with staged_tables() as kept:
            docs = stage(out, name)
        drop_tables(spark, spent + before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
