"""The corpus pipeline: documents in, packed sequences out.

Each stage is one operator; its result is written and read again as the next
one's documents.  Stages return the columns of documents, the last one its
pieces.  A stage works on all that its predecessor kept.

Defined cases, for all stages: null and empty texts are kept (they score as
clean, hold no lines, are no copies and pack as the end token); rows without
a doc_id are kept and never compared; rows that repeat a doc_id with equal
text are one document to each stage, so all of them stay or go alike and
are packed each; an empty table goes through; columns
that documents have besides are carried to the last stage.  n_chars, where
it is there, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import line_dedup, near_dedup, packing, repeats, toxicity
from formweave.llm.shared import new_folder


def _aside(docs: DataFrame, *made: str) -> DataFrame:
    """docs whose own columns of names that an operator makes are out of its way."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in made if c in docs.columns})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs in their order, n_chars following the text."""
    own = [F.col(f"__own_{c}").alias(c) if f"__own_{c}" in out.columns else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*own)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is learnt from labels of these documents."""
    model = toxicity.train_on_rest(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "__score").filter(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents or more hold stay in one."""
    return _back(line_dedup.dedup_lines(_aside(docs, "n_lines", "n_dropped")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 hundredths of their five-word shingles one stays."""
    return _back(near_dedup.near_dedup(_aside(docs, "n_shingles", "component_id", "kept")).filter("kept"), docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more stay where they come first; half characters at the cuts go."""
    cut = repeats.cut_repeats(_aside(docs, "kept", "n_removed", "n_spans"), as_text=True)
    return _back(cut.withColumn("text", F.col("kept")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("packing", pack),
]

#: Scores, minhash and tokens have no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
