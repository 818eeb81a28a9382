"""Queries p2, p3, p4, p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from .ann import most_similar, similar_pairs
from .clusters import clusters, similarity_groups
from .leakage import leaked_items
from .personal import masked_texts, personal_information
from .subset import varied_subsets
from .tokenize import encode
from .vectors import usable_vectors


def _usable(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return usable_vectors(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "coll_config"), ("vec_values", *columns))


def p2_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, coll_name, rank, id: the chosen ids of every request."""
    return varied_subsets(_usable(spark, sf_dir, "metadata"), table(spark, sf_dir, "subset_requests"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coll_name, id, first_id: vectors in groups of similarity 0.85 or more."""
    return similarity_groups(_usable(spark, sf_dir))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coll_name, cluster, size, exemplars, usual: the stable clusters, described."""
    return clusters(_usable(spark, sf_dir, "metadata"))[1]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coll_name, id_a, id_b: similar pairs, from the 5 most similar of every vector."""
    return similar_pairs(_usable(spark, sf_dir))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coll_name, id, rank, near_id, similarity: the 5 most similar vectors of every vector."""
    return most_similar(_usable(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: the token ids of every text by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: documents and the evaluation items that leaked into them."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, start_pos: the places of personal information."""
    found = personal_information(table(spark, sf_dir, "documents"), table(spark, sf_dir, "given_names"))
    return found.select("doc_id", "kind", "start_pos")


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the texts with placeholders."""
    return masked_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "given_names"))


QUERIES = {"p8_found": p8_found, "p8_masked": p8_masked, "p7_found": p7_found, "p2_subsets": p2_subsets, "p3_found": p3_found, "p3_clusters": p3_clusters, "p4_found": p4_found, "p4_nearest": p4_nearest, "p6_ids": p6_ids}
SQL: dict[str, str] = {}
