"""A training corpus from raw documents: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import stages
from tracewright.llm._frames import read_table, shared_dir

STAGES = [
    ("quality classifier", stages.quality_filter),
    ("line dedup", stages.line_dedup),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("benchmark decontamination", stages.decontamination),
    ("mixing sources to target weights", stages.mixing_blocks),
]

#: The classifier and the joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written as Parquet to the shared folder and read again.

    A stage's table goes when the next one is written; the last one stays for whoever reads the result.
    """
    import uuid

    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
