"""From raw documents to token ids: STAGES in order, each over all that the one before kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of ``documents``. ``run`` writes each stage's
result as Parquet in the shared folder and rereads it as the next one's docs.

In every stage a null doc_id, lang, source or n_chars is no reason to drop a
row, texts of any length go whole, and an empty table gives an empty one. Extra
columns pass through; one named like an output of a stage's operator carries
that output from there on. What a stage does with null and empty texts and with
repeated rows is said at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, common, language_id, mixing, ngram_join, pii

#: Below this fit to its mixture of languages (1: as training texts, 0: nothing but unseen trigrams) a text is in no learned one.
LEAST_FIT = 0.4

#: Bytes of the batches in which rows go to Python workers and back: whole texts, so that a number of rows says nothing.
BATCH_BYTES = 16 << 20


def _bounded(spark: SparkSession) -> None:
    """Stages are evaluated after they return, so that the setting stays for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that no mixture of the learned languages explains; lang stays as labelled.

    Null and empty texts have no letter. Repeated rows are judged alike.
    """
    _bounded(spark)
    model = language_id.train(docs)
    kept = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("__fit") >= LEAST_FIT)
    return language_id.identify(docs, model, fit="__fit").where(kept).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each class of near copies; of repeated rows one.

    Null and empty texts have no words, so that each is a copy of every other one.
    """
    _bounded(spark)
    return ngram_join.one_of_each(docs)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites text, and n_chars with it; null and empty texts stay, repeated rows stay and get equal texts."""
    _bounded(spark)
    return pii.replace(docs, pii.key_of(spark)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget has it; 0 times drops it.

    Null lang and source count, and come out, as ``-``. Null and empty texts
    cost nothing. Repeated rows are taken or dropped together.
    """
    mixed = mixing.mix(docs, mixing.default_levels(docs), mixing.TARGET)
    epoch = common.fresh("epoch", mixed.columns)
    return mixed.where("epochs > 0").withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col("epochs")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with the digests of ids and decoded text; null and empty texts have none."""
    import public_tokenizers

    _bounded(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=True, keep_text=False)


STAGES = [
    ("language_id", identify_languages),
    ("ngram_join", drop_near_copies),
    ("pii", replace_private_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages with learned models and keyed surrogates have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        target, before = common.work_dir(spark, f"pipeline-{name}"), docs
        with common.temporary(spark):  # what a stage wrote for itself goes when its result is complete
            docs = common.write_to(stage(spark, before, sf_dir), target)
        if i:
            common.discard(before)
    return docs
