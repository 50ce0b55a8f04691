"""The corpus pipeline: quality rules, near duplicates, benchmark passages, source mix, token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that ``run`` writes as
Parquet to the shared folder and reads again for the next stage, so a lost executor costs
at most one stage's tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm import decontaminate, mixing, ngram_join, quality_rules, token_files
from staywise.llm.queries import vocabulary
from staywise.session import new_folder, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    # A bare column would be tested for null first, and the measures computed twice for it.
    return quality_rules.judge(docs).filter(F.coalesce("kept", F.lit(False))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles, the least id stays."""
    return ngram_join.keep_one(docs, width=5, percent=80).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.find_contamination(docs, benchmark).filter(~decontaminate.contaminated()).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mixed(docs, COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix and what they hold, read back from them."""
    folder = new_folder(spark, "token-files")
    token_files.write_token_files(docs, folder, vocabulary("word_bpe_49k.json"))
    return token_files.token_index(spark, folder)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: Token files and random rounding are beyond SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), re.sub("[^a-z]+", "-", name.lower()))
    return docs
