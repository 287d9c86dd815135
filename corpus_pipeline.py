"""Documents to training ids: five stages, each over all that the one before it kept.

Every stage takes and returns documents (doc_id, text, lang, source, n_chars); the last returns
ids. A stage's result is written to the shared folder and read again by the next.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweave.llm import language, mixing, personal, pieces, shingle_join
from newsweave.session import write_out

TOKENIZER = "piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language.

    Those without a letter, or without text, go. A missing label is filled with the prediction.
    """
    model = language.learn(docs.where(language.fold(F.col("doc_id")) != 0))
    found = language.identify(docs, model).where(F.col("lang_pred") != language.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return shingle_join.one_of_each(docs, words=5, num=80, den=100)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; all documents stay."""
    return personal.mask_personal(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with whether decoding them gives the text back."""
    model = pieces.read_model(public_tokenizers.path(TOKENIZER))
    encoded = pieces.round_trip(docs, model)
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]
# Language codes, merges and masks are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = write_out(stage(spark, docs, sf_dir), name)
    return docs
