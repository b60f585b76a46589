"""The stages of the corpus pipeline; each applies one operator of this folder to all its input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringmatch.llm import language, packing, passages, secrets, simhash
from ringmatch.llm.common import scratch_path, written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents in a language that the labelled ones teach; all others go.

    Rejected are texts that are null, hold no letter, or need more phrases in their nearest language than its own
    texts do, see ``language.identify``. Where no row is labelled nothing can be learned and all documents stay.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs
    found = docs.withColumn("__found", language.classifier(spark, model)(F.col("text")))
    return found.where("__found.known").drop("__found")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each group of near copies the document with the smallest id stays.

    Rows that share an id are one document; rows with a null id cannot be named and stay.
    """
    groups = simhash.near_duplicates(docs).where("doc_id <> component_id")
    gone = written(groups.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: passages that another document keeps are cut out; documents of which nothing is left go.

    All other texts stay as they are, null ones too.
    """
    cuts = passages.removals(passages.repeated_passages(docs))
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))
    cuts = written(cuts, "cuts")
    joined = docs.join(cuts, F.col("doc_id") == F.col("__id"), "left")
    untouched = F.col("__spans").isNull() | F.col("text").isNull()
    text = F.when(untouched, F.col("text")).otherwise(passages.without(F.col("text"), F.col("__spans")))
    changed = _with_text(joined, text, ~untouched)
    return changed.where(untouched | (F.col("text") != "")).select(*docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: every span of a secret is replaced by its kind in brackets; nothing else changes.

    Texts are joined to their findings by content; only texts with findings are rewritten.
    """
    ledger = scratch_path(spark, "ledger")
    secrets.scan_versions(docs, ledger)
    per_blob = secrets.findings_by_path(docs, ledger).where(F.size("findings") > 0)
    per_blob = per_blob.select(F.col("blob").alias("__blob"), F.col("findings").alias("__findings"))
    per_blob = per_blob.dropDuplicates(["__blob"])
    marked = docs.withColumn("__of", F.sha2(F.col("text"), 256))
    joined = marked.join(per_blob, F.col("__of") == F.col("__blob"), "left")
    text = F.when(F.col("__findings").isNull(), F.col("text")).otherwise(
        secrets.redacted(F.col("text"), F.col("__findings"))
    )
    return _with_text(joined, text, F.col("__findings").isNotNull()).select(*docs.columns)


def _with_text(docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The new text; ``n_chars``, where there is such a column, follows it in ``changed`` rows."""
    docs = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        docs = docs.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return docs


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: all texts packed into sequences of 2,048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


STAGES = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("secrets", remove_secrets),
    ("pack", pack_sequences),
]
