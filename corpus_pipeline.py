"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the documents are written as Parquet and read again. All but the last return
the columns of ``documents``: further columns, whatever their names, are set
apart in a struct and come back as they were.

Defined cases: null, empty and blank texts are rejected by the quality rules,
and later stages, given any, keep them as the documents they are (each is a
group of its own; the mix takes documents of size 0 as often as whole
repetitions say); texts of any length take the same path; rows that repeat an id
and a text count as one in the near-copy stage, otherwise rows are
separate; null ids are ids like any other; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import bpe, line_dedup, mixing, ngram_join, quality
from brightloom.llm.common import discard, materialize, n_words, packed, scratch, small_or_plain, table


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, list]:
    """The needed columns, all others in one struct, and the columns to select
    to have them all back."""
    slim, rest = packed(docs, *needed)
    back = dict(zip([c for c in docs.columns if c not in needed], rest, strict=True))
    return slim, [back.get(c, c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    slim, columns = apart(docs, "doc_id", "text")
    judged = quality.judge(slim, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return judged.where("kept").select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those with no other lines go."""
    slim, columns = apart(docs, "doc_id", "text", "n_chars")
    done = line_dedup.dedup(slim).where("n_kept > 0 or n_lines = 0")
    return done.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id."""
    linked = ngram_join.link_components(docs, counted=False)
    kept = linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("stays")
    kept, _ = small_or_plain(materialize(kept.select(F.col("doc_id").alias("kept_id"), F.col("n").alias("kept_n"))))
    slim, columns = apart(docs, "doc_id", "text")
    joined = slim.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")))
    once = joined.where("kept_n = 1").select(*columns)
    return once.union(joined.where("kept_n > 1").dropDuplicates(["doc_id", "text"]).select(*columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that a source takes in
    part is taken if that is half of it or more."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    mixed = mixing.mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), whole))
    times = F.col("copies") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("int")
    return mixed.select("document", F.explode(F.array_repeat(F.lit(True), times.cast("int")))).select("document.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each document."""
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: Hashing, tokenising and training aren't SQL; the tests hold each stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, after = docs, []
        with scratch(after):  # a stage's own tables go once its documents are written
            docs = materialize(stage(spark, before, sf_dir))
            after.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
