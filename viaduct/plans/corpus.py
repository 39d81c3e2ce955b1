"""Queries over documents and their labels: judging, reasons, joins with lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import rules
from viaduct.plans.registry import query
from viaduct.sources.tables import load


@query("""
SELECT d.doc_id, [x FOR x IN [
    CASE WHEN d.n_chars < 200 THEN 'short' END, CASE WHEN d.n_chars > 20000 THEN 'long' END,
    CASE WHEN l.quality = 0 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END] IF x IS NOT NULL] AS reasons,
  NOT (d.n_chars < 200 OR d.n_chars > 20000 OR coalesce(l.quality = 0, false) OR coalesce(l.toxic = 1, false)) AS keep
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def judge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with all its reject reasons, in the order of the rules."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = load(spark, sf_dir, "labels")
    judged = rules.judge(docs.join(labels, "doc_id", "left"), {"short": F.col("n_chars") < 200, "long": F.col("n_chars") > 20000, "quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return judged.select("doc_id", "reasons", "keep")
