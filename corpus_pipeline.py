"""Corpus pipeline: documents -> identified -> deduplicated -> decontaminated -> mixed -> token files.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works
on every row its predecessor kept and returns a DataFrame.  All but the last return
the columns of ``documents``; ``run`` chains them, each one's rows written as Parquet
in the shared folder and read again by the next.

Stages keep their tables in the shared folder, so any number of them can be held at
once and an action can be run again.  ``run`` owns the paths of its stages: it deletes a
stage's tables once the stage's rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeline.llm.common import delete, new_path, recorded, saved, table
from lakeline.llm.decontaminate import drop_contaminated
from lakeline.llm.language_id import drop_unidentified
from lakeline.llm.mixing import mix
from lakeline.llm.queries import MIX_WEIGHTS, mix_levels, tokenizer_path
from lakeline.llm.simhash import drop_near_duplicates
from lakeline.llm.token_files import read_token_files, write_token_files

# SQL expresses neither SimHash nor edit distance nor the tokenizer.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a posterior of a half or more; others go."""
    return drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash component: 4-word shingles, at most 4 bits apart."""
    return drop_near_duplicates(docs, shingle=4, distance=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all tokens, drawn to the target weights without repeats."""
    return mix(docs, mix_levels(), MIX_WEIGHTS, share=0.9, max_epochs=1).select("doc.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the token files."""
    path = new_path(spark, "pipeline-tokens")
    # Less than the default: workers still hold memory of earlier stages.
    write_token_files(docs, path, tokenizer_path(), block_bytes=2 << 20, max_words=500_000)
    return read_token_files(spark, path, with_ids=False)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        with recorded() as paths:
            docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage{i}")
            delete(spark, paths)
    return docs
