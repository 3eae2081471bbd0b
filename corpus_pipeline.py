"""The corpus pipeline: documents -> language ID -> near-duplicates -> secrets -> mix -> token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which
``run`` writes as Parquet to the shared checkpoint folder and reads again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import jaccard, langid, mixing, pieces, secrets
from riskframe.llm.common import held_out, materialize, table
from riskframe.llm.queries import MIX_EPOCHS, MIX_WEIGHTS, piece_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or a candidate language; sets ``lang`` to the one with most letters.

    A null, empty or letterless text goes; a tie goes to the first language by code point order; repeated rows and rows with a null id are
    judged each by its own text; texts of any length are read whole; other columns, also with clashing names, stay as they are; an
    empty table gives an empty one. Learns from the rows that are not held out; without labelled rows every document goes."""
    return langid.keep(docs, langid.fit(docs, ~held_out(F.col("doc_id"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents only the one with the smallest id stays.

    Repeated rows are a group like any other; of rows that share an id each is judged by its own text; rows without an id or without a word
    all stay; columns and the rows that stay are unchanged; an empty table gives an empty one."""
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become <kind>, and ``n_chars`` is the new length.

    Overlapping secrets are masked from the first start to the last end; null and empty texts, other columns and repeated rows stay as they are; an
    empty table gives an empty one."""
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a repetition of a document that the mix takes.

    A null source is a source, the last in order; documents without words are not taken; a fraction takes the document's first words; ties are
    broken by a hash of id and text, and equal rows share the repetitions; an empty table gives an empty one; same columns."""
    return mixing.repeat(docs, MIX_WEIGHTS, MIX_EPOCHS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids; one row a row. A null or empty text has the begin and end ids alone; other columns are dropped."""
    return pieces.tokens(docs, piece_model())


STAGES = [("language_id", language), ("ngram_jaccard", near_duplicates), ("secret_scan", mask_secrets),
          ("source_mix", mix_sources), ("sentencepiece", tokenize)]

#: No stage has a SQL form as a whole; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
