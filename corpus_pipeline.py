"""A corpus made ready for training: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hitsieve.llm.bpe import tokenize
from hitsieve.llm.classifier import keep_good
from hitsieve.llm.common import store
from hitsieve.llm.linededup import dedup_lines
from hitsieve.llm.mixing import mix_sources
from hitsieve.llm.ngramjoin import drop_near_copies

STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("bpe tokens", tokenize),
]
# trained weights and MinHash pruning have no SQL form; tests/llm holds the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
