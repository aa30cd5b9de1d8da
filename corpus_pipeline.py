"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Columns beyond those of
documents pass through all stages but the last; own columns that an operator would add are replaced. An
empty table gives none, a very long text is read whole. A null id is an id that sorts last, a null source one
of its own; rows that repeat an id and text are kept or left out alike until the n-gram join keeps one.

language_id     documents that the classifier rejects (no letters, null text, or a calibrated
                probability below its threshold) go
line_dedup      lines that repeat or nearly repeat an earlier one go; documents left without words go
ngram_join      of each group of similar documents the one with the smallest id stays (null last; of equal ids the
                one with the smallest text hash). Rows are told apart by id and text, so dissimilar documents
                that share an id or have none all stay, and so does each row without words
mix             documents enter as often as their source's target asks, in curriculum order
pack            pieces of at most 2048 tokens with their place in packed sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bestfit_pack, curriculum_mix, language_id, line_dedup, ngram_join
from quarryline.llm._common import remove, scratch, stage, staged_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identify(docs, language_id.fit(docs.select("doc_id", "text", "lang")))
    return found.filter(~F.col("lang_rejected")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = ngram_join.similar_rows(docs).filter("root is not null").select("k", "th", "root")
    first = rows.groupBy("root").agg(F.min(F.struct("k", "th")).alias("first")).select("first.*")
    each = rows.groupBy("k", "th").agg(F.count("*").alias("c"))
    lost = stage(each.join(first, ["k", "th"], "left_anti").select(F.col("k").alias("_k"), F.col("th").alias("_th")), "lost")
    twice = stage(each.filter("c > 1").join(first, ["k", "th"], "left_semi").select(F.col("k").alias("_k"), F.col("th").alias("_th")), "twice")
    same = (line_dedup.row_key() == F.col("_k")) & (F.xxhash64("text") == F.col("_th"))
    kept = docs.join(line_dedup.small(lost), same, "left_anti")
    if twice.isEmpty():
        return kept
    # rows that repeat an id and text: one of them stays
    row = F.struct(*docs.columns)
    again = kept.join(twice, same).groupBy("_k", "_th").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return kept.join(twice, same, "left_anti").unionByName(again)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum_mix.curriculum(curriculum_mix.mix(docs, [1, 2, 3], whole=True)).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bestfit_pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("ngram_join", similar_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: The classifier's weights are no SQL; tests hold the stages to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir. What a stage has staged goes once its result is written, and
    that once the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        path = staged_path(spark, name)
        with scratch(spark):
            out = step(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
