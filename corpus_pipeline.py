"""From raw documents to packed training sequences, in five stages.

Each stage reads the documents that the one before kept, as Parquet in the shared folder. Source
mixing gives them an order, which is that of its files and of the rows in them; packing goes by
it, so that sequences in the order of their numbers hold the sources in their shares.

Every stage works on rows, not ids: rows with one id, or none, stay documents each, and where
stages drop some they drop rows. A null text is empty: the quality classifier scores it like any
other, language identification finds no language in it and rejects it. Repeated rows are near
duplicates of each other, and one stays. An empty table gives an empty table, and columns
besides those of documents are dropped, whatever their names. Texts are read and kept whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import langid, mixing, packing, quality, simhash
from scriptorium.llm.common import Scratch, discard, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose pooled probability of their likeliest language is lower are rejected.
LEAST_LANGUAGE = 0.3
#: Documents of the mix, one after another, that packing may put in another order.
WINDOW = 1024


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    out = quality.score(docs, table(spark, sf_dir, "labels"), columns=COLUMNS)
    return out.where("predicted = 1").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language."""
    out = langid.identify(docs, columns=COLUMNS)
    return out.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that with the smallest id, then the smallest digest of its text; null ids come last."""
    docs = docs.select(*COLUMNS).withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    rows = simhash.groups(docs, columns=("digest",))
    # an aggregate, as a group may hold most rows
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"))
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["__id"]) & (docs["digest"] == first["__digest"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "digest"]).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    rest = [c for c in COLUMNS if c not in ("doc_id", "source")]
    # the mix names a null source ''
    out = mixing.mix(docs.withColumn("__source", F.col("source")), columns=(*rest, "__source"))
    return out.repartitionByRange("position").sortWithinPartitions("position").select(*(F.col("__source").alias(c) if c == "source" else c for c in COLUMNS))


def windows(docs: DataFrame) -> DataFrame:
    """`docs` with __part, __piece and __window, by which they are in the order in which they were written.

    Readers deal files to tasks by size, so that only a file's numbers and a row's place in it
    tell that order; rows that were not just read from files are in the order of their partitions."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0))
        part, piece, row = number(r"^part-(\d+)"), number(r"-c(\d+)\."), F.col("_metadata.row_index")
    else:
        n = F.monotonically_increasing_id()
        part, piece, row = F.shiftright(n, 33), F.lit(0), n.bitwiseAND(F.lit((1 << 33) - 1))
    return docs.select("doc_id", "text", part.alias("__part"), piece.alias("__piece"), F.floor(row / WINDOW).alias("__window"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 ids, in the order of the mix: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    return packing.pack(windows(docs), public_tokenizers.path("byte_bpe_50k.json"), windows=("__part", "__piece", "__window"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language id", language_id),
    ("simhash near-dedup", near_duplicates),
    ("source mixing", source_mix),
    ("packing", packed),
]
#: SQL can express neither the trained stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables that a stage wrote on its way go once its result is written, and so does the result of the stage before."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with Scratch() as scratch:
            docs = scratch.keep(materialise(stage(spark, docs, sf_dir), "stage"))
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
