"""A corpus pipeline of five of the operators: each stage's result is written as Parquet and read by the next one."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import cut, ranked, shared_dir, table
from tensorloom.llm.exact_dedup import DigestIndex, exact_dedup
from tensorloom.llm.langid import UND, fit, identify
from tensorloom.llm.ngram_join import ngram_jaccard_join
from tensorloom.llm.packing import pack
from tensorloom.llm.pii import pseudonymise
from tensorloom.llm.queries import PII_KEY, WINDOW, held_out, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a learned language; the others (null, without letters) go."""
    filters = fit(docs.where(~held_out()))
    return identify(docs.select(*COLUMNS), filters).where(f"lang_pred <> '{UND}'").select(*COLUMNS)


MOST_FILES = 500_000  # 8 MB of broadcast; beyond, rows are numbered by writing them


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, so that rows that share or lack an id stay apart. Rows of Parquet files are numbered
    by file and place, whatever tasks read them; others are written first."""
    try:
        placed = docs.select(*COLUMNS, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        placed = None
    if placed is not None:
        files = ranked(placed.select("file").distinct(), ["file"], "number")
        if files.count() <= MOST_FILES:
            row = F.shiftleft("number", 38).bitwiseOR(F.col("place"))
            return placed.join(F.broadcast(files), "file").select(*COLUMNS, row.alias("row"))
    return cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: one with the largest doc_id, or with none if the group has none."""
    name = f"digests_{uuid.uuid4().hex}"
    rows = numbered(docs)
    index = DigestIndex(spark, name, location=f"{shared_dir(spark)}/tensorloom/{name}", rows=docs.count())
    kept = cut(exact_dedup(rows, index, "pipeline", carry=("row",)).where("kept").select("row"), "kept")
    index.drop()
    return rows.join(kept.hint("merge"), "row", "left_semi").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): one with the smallest doc_id, or with none if the group has
    none. Rows that share an id and texts that are not near are different documents."""
    rows = numbered(docs)
    found = ngram_jaccard_join(rows, k=5, percent=80, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    first = F.coalesce("doc_id", F.lit(2**63 - 1))
    kept = rows.select("row", first.alias("first")).join(found, "row").groupBy("component_id").agg(F.min_by("row", "first").alias("row")).select("row")
    return rows.join(cut(kept, "kept").hint("merge"), "row", "left_semi").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars stays right, since pseudonyms keep the length except in IPv4 numbers, so it is set anew."""
    return pseudonymise(docs.select(*COLUMNS), PII_KEY).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, window=WINDOW)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens of a BPE file and fitted filters are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
