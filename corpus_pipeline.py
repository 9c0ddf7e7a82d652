"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet to the shared
folder and read again as the next one's docs.  All but the last return the columns of documents, whatever their
names.  For all stages: rows are judged whole, however long their texts; an empty table gives an empty one; further
columns are handed on.  What nulls, repeated rows and ties come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.bpe import bpe
from riskloom.llm.common import cut
from riskloom.llm.decontaminate import uncontaminated
from riskloom.llm.jaccard_join import jaccard_join
from riskloom.llm.langid import UNKNOWN, language_id
from riskloom.llm.secrets import secret_scan

#: Predictions less confident than this are rejected: 0 is a guess among the learned languages, however many, 1 certainty.
MIN_CONFIDENCE = 0.1


def _packed(docs: DataFrame) -> DataFrame:
    """docs' columns in one, so that none of them meets a result of its name, beside those an operator reads."""
    read = [F.col(c) for c in ("doc_id", "text", "lang") if c in docs.columns]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *read)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; those without any letter or text go, and those it can only guess at.

    A null text goes; a row without doc_id is judged as any other, but nothing is learned from it; repeated rows are judged alike; of
    equally likely languages the first by name counts, and their confidence is that of a guess."""
    told = language_id(_packed(docs), keep=("_row",))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("confidence") >= MIN_CONFIDENCE)).select("_row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id.

    Rows without doc_id can't be told from others and stay; so do null and blank texts, which link with nothing; rows that share the
    doc_id that stays all stay, rows that share another all go (an id with several texts goes if one of them has a smaller copy)."""
    gone = cut(jaccard_join(docs).where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # a sort-merge join at every size; rows without an id stay where they are
    named = docs.where(F.col("doc_id").isNotNull()).join(gone.hint("merge"), "doc_id", "left_anti").select(*columns)
    return named.unionAll(docs.where(F.col("doc_id").isNull()).select(*columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't carry benchmark passages.

    Null and blank texts carry none; rows without doc_id and rows that share one are judged each by its own text; repeated rows alike.
    An empty benchmark, or one of blank items, keeps everything."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows.

    A null text stays null; rows are judged one by one, those without doc_id and repeated ones alike; spans that overlap or touch become
    one mark or two, but no character of them stays."""
    out = secret_scan(_packed(docs), keep=("_row",))

    def column(f):
        old = F.col("_row").getField(f.name)
        if f.name == "text":
            return F.col("redacted").alias("text")
        if f.name == "n_chars":
            return F.when(F.size("spans") > 0, F.length("redacted").cast(f.dataType)).otherwise(old).alias("n_chars")
        return old.alias(f.name)

    return out.select(*[column(f) for f in docs.schema.fields])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of ids and of what they decode to.

    A null text is an empty one; every row gives a row, with or without doc_id, repeated or not."""
    out = bpe(docs)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

#: A trained model and a tokenizer are not SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
