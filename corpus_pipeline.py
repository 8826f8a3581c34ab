"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

Toxic documents go, one document of each group of near copies stays, contaminated documents go,
personal data is replaced, and what is left is packed into sequences. All stages but the last return
the columns of the documents they are given, whatever these are called.

Defined cases, of every stage: null and empty texts are clean, copies of nothing, and packed as the end token alone; a null id
is an id like others, and is not looked up in labels; rows that repeat an id and its text are judged alike, and one of them stays
after near-dedup; of near copies the smallest id stays, null last; an empty table stays empty; without labels, or with one kind of
them only, no document is toxic; without benchmark items none is contaminated; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import decontaminate, neardup, packing, pii, toxicity
from pixelloom.llm.common import cut, prepare, read
from pixelloom.llm.queries import held_out, pii_key, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the model learns from labelled rows that are not held out."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.scored(docs, model, score_col="__toxicity").filter("__toxicity < 0.5").drop("__toxicity")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group, at five words and a similarity of 0.8."""
    prepare(spark)
    return neardup.one_of_each(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which hit words are less than one in twenty."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced and ``n_chars`` counted anew."""
    prepare(spark)
    found = pii.pseudonymise(docs, pii_key(spark))
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", without_toxic), ("near_dedup", without_near_copies), ("decontamination", without_benchmark),
    ("pii", pseudonymous), ("packing", packed),
]

#: The stages train models and pack sequences, which SQL cannot express. Tests hold each of them against a brute-force version:
#: scores from kernels summed over subsequences, all pairs of sets, all windows, texts with their surrogates put in, sequential packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
