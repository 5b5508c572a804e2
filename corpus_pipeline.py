"""A corpus pipeline over ``documents``: identify languages, drop shared lines, drop near copies
by SimHash, mix sources, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``, extra ones
included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import language_id, line_dedup, mixing, pieces, simhash
from tablewright.llm.common import n_words, stage, with_free_name
from tablewright.llm.queries import piece_model
from tablewright.sources.tables import table

LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no text or no letter in it, or a language that is less
    likely than all others together. Learns as ``op4`` does, from the labels in ``docs``. Every row is
    judged alone, equal rows alike; an empty table stays empty."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    language, score = (with_free_name(docs, name) for name in ("language_", "score_"))
    known = language_id.identify(docs, model, names=(language, score))
    accepted = (F.col(language) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)
    return known.where(accepted).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the lines that ten documents or more share; ``n_chars`` counts what is left. A
    document that loses every line stays, with an empty text."""
    kept = line_dedup.drop_shared_lines(docs, carry=docs.columns)
    text = F.when(F.col("_text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return kept.select(
        *(new.get(c, F.col("_carry")[c]).alias(c) for c in docs.columns)
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id. Rows that repeat an
    id with unlike texts stay; rows without an id join the groups of their texts."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes every document as often as the mix begins to take it: not at all, once or twice.
    Documents are not cut; documents without words, with NULL text among them, are never taken. Rows
    of one id are written as often as the one of them that is taken most; an empty table stays empty."""
    taken = mixing.mix(docs, n_words(F.col("text"))).taken().where("taken > 0")
    copies = taken.groupBy("_id").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).alias("_copies"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"))
    return (
        rows.join(copies, F.col("_doc").eqNullSafe(F.col("_id")))
        .select("_row", F.explode(F.expr("sequence(1, _copies)")))
        .select(*(F.col("_row")[c].alias(c) for c in docs.columns))
    )


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document that the mix has: ``ids``, as the model's own encoder merges
    them, and ``path_ids``, the best path through the lattice (Viterbi); and whether both give the text
    back. NULL and empty texts have no pieces; every row is encoded, also one that repeats an id."""
    encoded = pieces.encode(docs, piece_model(), paths=True)
    text = F.replace(F.coalesce("_text", F.lit("")), F.lit(pieces.MARK), F.lit(" "))
    return encoded.select(
        F.col("_id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_pieces"),
        "ids",
        "path_ids",
        ((F.col("decoded") == text) & F.col("path_agrees")).alias("round_trip"),
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Language identification and SimHash are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
