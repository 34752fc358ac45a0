"""Queries p7 to p9, over the whole table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binstrata.llm.encode import encode_corpus
from binstrata.llm.packing import pack
from binstrata.llm.splitting import split_documents
from binstrata.llm.tokens import token_counts
from binstrata.session import Scratch, table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", Scratch(spark, "p7"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of a larger one, with its container."""
    sized = token_counts(table(spark, d, "documents").select("doc_id", "text"))
    return pack(sized, "doc_id", "n_tokens")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packer had to split."""
    return p8_packed(spark, d).where(F.col("piece") == 1).select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document above the limit."""
    return split_documents(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were split."""
    return p9_pieces(spark, d).where(F.col("piece") == 0).select("doc_id")


QUERIES = {q.__name__: q for q in (p7_ids, p8_found, p8_packed, p9_found, p9_pieces)}
SQL: dict[str, str] = {}
