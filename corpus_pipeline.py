"""A corpus pipeline of the operators in quillgrid.llm: documents in, packed training sequences out."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm.common import forget_tables, owned, table, written
from quillgrid.llm.mixing import mix_stage
from quillgrid.llm.packing import packing_stage
from quillgrid.llm.quality import quality_stage
from quillgrid.llm.simhash import near_duplicate_stage
from quillgrid.llm.suffixes import suffix_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def after_writing(stage: Stage) -> Stage:
    """The stage, freeing first the working tables of earlier ones: their results have been written, and are ``docs``."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with owned("stages"):
            forget_tables(docs)
            return stage(spark, docs, sf_dir)

    return run_stage


#: (name, function): (spark, docs, sf_dir) -> DataFrame.  All but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", after_writing(quality_stage)),
    ("near_duplicates", after_writing(near_duplicate_stage)),
    ("suffix_dedup", after_writing(suffix_stage)),
    ("mix", after_writing(mix_stage)),
    ("packing", after_writing(packing_stage)),
]
#: SQL cannot express fingerprints, exact bounds or best fit; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    with owned(uuid.uuid4().hex):
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
