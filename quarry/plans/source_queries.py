"""Queries of scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.sources import readers


@query("keyset_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderdate > TIMESTAMP '1996-01-01' ORDER BY o_orderkey LIMIT 500")
def _(t):
    return readers.keyset_scan(t("orders"), "o_orderkey", 100, 500, "1996-01-01 00:00:00", "o_orderdate").select("o_orderkey", "o_custkey")


@query("corpus_scan", "SELECT 'orders' AS source, o_orderkey::VARCHAR AS doc_id, o_orderstatus || ' ' || o_orderpriority AS text, o_orderdate::DATE AS timestamp FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' ORDER BY o_orderkey LIMIT 20000")
def _(t):
    found = readers.corpus_scan(t("orders"), "orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"], "o_orderdate", F.array().cast("array<string>"), ("1996-01-01", "1996-03-31"), 20_000)
    return found.drop("entities")


@query("attachment_scan", "SELECT doc_id AS original_id, length(text)::INT AS n FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id LIMIT 300")
def _(t):
    d = t("documents").select(F.col("doc_id").alias("original_id"), F.col("text").alias("clean_content"))
    ids = t("labels").where("toxic = 1").select(F.col("doc_id").alias("original_id"))
    return readers.attachments(d, ids, 300).select("original_id", F.length("clean_content").alias("n"))
