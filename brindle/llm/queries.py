"""Queries pN_ of this subpackage: problems 3, 5, 6 and 7 of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.bpe import encode
from brindle.llm.cooccurrence import every_pair, pair_counts
from brindle.llm.packing import pack_texts, summary
from brindle.llm.subjects import classify, fit
from brindle.operators.packed import once_per_key
from brindle.session import table
from brindle.storage import materialize


def _goods(spark: SparkSession, d: str) -> DataFrame:
    return once_per_key(table(spark, d, "shop_orders"), "items", "id", values="items", fold_values=True)


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of goods that share an order, however few, with their counts and their lift over chance."""
    return every_pair(_goods(spark, d), "items")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    pairs = pair_counts(_goods(spark, d), "items", least=5, share=2000)
    return pairs.where(wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b") * 3).select("item_a", "item_b")


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "text", ["doc_id"])


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Container of each document, or of each piece of those longer than 2,048 tokens."""
    return pack_texts(table(spark, d, "documents"), "text", ["doc_id"])


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """How well p6_pack fills its containers: their number, the least conceivable, the gap, and the room left over."""
    return summary(materialize(p6_pack(spark, d), "packed"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    areas = sorted(r["subject"] for r in table(spark, d, "subject_areas").select("subject").where("subject is not null").collect())  # 10 rows, fixed
    model = fit(docs, table(spark, d, "doc_labels"), areas, "doc_id", "text", "subject")
    return classify(docs, model, "text", ["doc_id"]).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p3_found, p3_pairs, p5_ids, p6_pack, p6_summary, p7_found)}
SQL: dict[str, str] = {}
