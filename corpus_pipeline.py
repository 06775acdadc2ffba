"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last give the columns of `documents`, of the rows they keep.

Null and empty texts: language ID rejects them, as it does texts without a letter. A null id: the row is never a near
copy, a leak, or a holder of lines, and stays. Ties and repeated rows are as each operator says. Further columns of the
input are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontamination, language_id, line_dedup, piece_bpe, simhash
from tidegauge.llm.common import checkpoint_dir, held_out, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies are texts whose five-word shingles are similar by 0.8 or more. Fingerprints of three-word shingles differ
#: in at most this many bits for most of them; a prefix filter finds the others, and all are verified.
NEAR_SHINGLE, NEAR_RADIUS, SIMILAR_SHINGLE = 3, 7, 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: null texts and texts without a letter."""
    model = language_id.train(docs, lambda c: ~held_out(c))
    told = language_id.predict(docs, model, keep=COLUMNS)
    return told.where("lang_pred <> 'und'").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that five or more documents share out of all of them but the last; n_chars follows the text."""
    index = line_dedup.build(docs, with_filters=False)
    thinned = line_dedup.apply(index, docs, keep=["doc_id", "lang", "source"])
    return thinned.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    return simhash.keep_one_similar(docs.select(*COLUMNS), SIMILAR_SHINGLE, NEAR_SHINGLE, NEAR_RADIUS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    import public_tokenizers

    return piece_bpe.round_trip_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("piece_encoding", encode_pieces),
]

#: Neither the language filter nor near copies, edit distances and pieces can be put in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what a stage gives is a table in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
