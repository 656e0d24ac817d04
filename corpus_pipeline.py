"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Every stage reads what its predecessor kept, whole texts; its decisions take effect in what it
returns. All but the last return the columns of ``documents``, in their order, whatever other
columns there are and however they are named; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.llm import decontamination, language_id, packing, simhash, suffix_dedup
from veritable.llm.common import held_out, materialize, packed, unpacked


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the profiles know: null text or no letter at all.
    Rows without a language teach nothing but are judged; repeated rows are judged alike."""
    profiles = language_id.fit(docs.where(~held_out()).select("text", "lang"))
    rows = language_id.predict(docs, profiles, [packed(docs.columns).alias("carried")])
    return rows.where("lang_pred <> 'und'").select(*unpacked(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates, in all its rows. Documents
    with a null doc_id stay; null and empty texts are one group."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every repeated 100-byte string after its first occurrence out of the texts;
    documents of which nothing is left go. Null texts stay null; n_chars, if there, follows."""
    others = [c for c in docs.columns if c != "text"]
    rows = suffix_dedup.remove_repeats(docs, with_text=True, carry=packed(others, no_text=F.col("text").isNull()))
    cut = F.col("n_removed") > 0
    out = dict(zip(others, unpacked(others))) | {"text": F.when(~F.col("carried.no_text"), F.col("kept_text")).alias("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.where(~cut | (F.trim("kept_text") != "")).select(*(out[c] for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; null and empty texts stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Language profiles, tokenizers and radix passes are beyond SQL; tests/llm/ compares every
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
