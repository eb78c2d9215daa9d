"""Five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before
kept, and gives a frame that is written as Parquet and read again for the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, minhash, pii, quality, scratch, sentencepiece_fst
from larkspur.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts are scored as texts without words; rows that repeat are each
    judged, all the same; an empty table stays empty, and without labels nothing goes.
    """
    model, score = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), scratch.free_name(docs, "_score")
    return quality.score(docs, model, out=score).filter(F.col(score) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows that share a document id one is kept, with the longest text, then the
    smallest.  Rows without an id are linked with nothing; of those with equal texts
    one is kept.
    """
    name = lambda x: scratch.free_name(docs, x)
    own, n, alone_text, packed, shorter = (name(x) for x in ("_id", "_n", "_text", "_row", "_shorter"))
    dropped = minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    # Ids on several rows, null among them; texts are grouped for these only.
    again = scratch.cut(docs.groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).select(own))
    if again.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col(own))
    order = F.struct(-F.coalesce(F.char_length("text"), F.lit(0)).alias(shorter), *[F.col(c) for c in ["text", *[c for c in docs.columns if c != "text"]]])
    alone = F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    first = kept.join(again, same, "left_semi").groupBy("doc_id", alone.alias(alone_text)).agg(F.min(order).alias(packed)).select(*[F.col(f"{packed}.{c}").alias(c) for c in docs.columns])
    return kept.join(again, same, "left_anti").unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay; rows that repeat are each judged; an empty
    benchmark or table removes nothing.
    """
    out = scratch.free_name(docs, "_contamination")
    marked = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out)
    return marked.filter(F.col(out)["n_hit"] == 0).select(*docs.columns)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data is replaced by its kind; n_chars follows.

    Every row is kept; a row without personal data, null texts among them, stays as
    it is.
    """
    before = scratch.free_name(docs, "_before")
    changed = pii.mask(docs.withColumn(before, F.col("text")))
    n_chars = F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return changed.withColumn("n_chars", n_chars).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids, ids: the piece ids of each text.

    A null or empty text has no ids; rows that repeat are each encoded; an empty table
    gives no rows, and other columns are left out.
    """
    made = sentencepiece_fst.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", mask_pii),
    ("SentencePiece encoding and decoding", tokenize),
]

#: Nearest-neighbour votes and piece ids have no SQL form; tests compare the
#: pipeline with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage has read is removed as soon as its own rows are written; the rows of
    the last stage are a checkpoint, which Spark removes with the last plan on it.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs, read = stage(spark, docs, sf_dir), path
            if k < len(STAGES) - 1:
                path = scratch.fresh_dir(spark, f"stage-{k}")
                try:
                    docs.write.parquet(path)
                finally:
                    if read:
                        scratch.remove_dir(spark, read)
                docs = spark.read.parquet(path)
            else:
                docs = scratch.cut(docs)
        return docs
    finally:
        if path:
            scratch.remove_dir(spark, path)
