"""The corpus pipeline: documents in, token ids of the clean, deduplicated and decontaminated rest out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import read, stored
from quire.llm.decontamination import drop_contaminated
from quire.llm.neardup import drop_near_duplicates
from quire.llm.pieces import encode_stage
from quire.llm.repeats import remove_repeats
from quire.llm.toxicity import drop_toxic

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_text", remove_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_stage),
]

#: A model's verdicts and token ids are beyond SQL; tests/llm compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
