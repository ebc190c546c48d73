"""A corpus pipeline: language ID, near-duplicate removal, secrets, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), docs being a stored table with the columns of documents, and returns a DataFrame;
all but the last return these columns, whatever other columns there are and whatever their names. A stage sees every row that its predecessor kept.
An empty table gives an empty one; rows that repeat are looked at one by one, texts of any length whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, mixing, neardup, secrets
from factloom.llm.columns import numbered
from factloom.llm.queries import pieces_path
from factloom.llm.sentencepiece import Codec
from factloom.session import cut

#: A text unlike a language has a cosine of mean 0 and deviation 1/sqrt(DIM) with its prototype: four times that is above the noise.
MIN_SCORE = 4 / langid.DIM**0.5
#: The few trigrams of a clean text of fewer letters don't stand out from the noise either, so it is too short to be rejected by its score.
SHORT = 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language: no letters, or `SHORT` letters at least and unlike all languages. A null lang becomes the predicted one.

    Null and empty texts have no letters and go; without any labelled row all go.
    """
    docs, named = numbered(docs, "text", "lang")
    judged = langid.predict(docs, langid.train(docs))
    short = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) < SHORT
    kept = judged.where((F.col("lang_pred") != "und") & ((F.col("score") > MIN_SCORE) | short))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).transform(named)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the smallest doc_id, a null one last, and of rows that tie the first. Null texts and texts without words stay."""
    return neardup.dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become <ASSIGN>, <ACCESS>, <HEX> or <MARKOV>; n_chars follows. No document goes; a null text stays null."""
    return secrets.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, 0 to 2 times; a null source is a source of its own."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (the pieces) and n_tokens of each document; null for a null text."""
    coded = Codec(spark, pieces_path(spark)).encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("source mixing", mix_sources),
    ("SentencePiece", encode),
]

#: Signatures, Markov models and pieces are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
