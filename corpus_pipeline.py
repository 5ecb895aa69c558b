"""The corpus pipeline: language, near copies, benchmark leaks, personal data, mixture.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  ``run`` applies them to ``documents``; each stage's result is written to
the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripwire.llm.common import materialize, table
from tripwire.llm.decontaminate import decontamination_stage
from tripwire.llm.language_id import language_stage
from tripwire.llm.minhash import dedup_stage
from tripwire.llm.mixing import mixing_stage
from tripwire.llm.pii import pii_stage

STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: language identification is learned, so SQL cannot express the result
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
