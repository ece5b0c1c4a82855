"""The ten most viewed, not yet rated catalogue items whose text has all the query words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import enrich, ordered, predicates, rollups
from . import base


def flagship(spark: SparkSession, d: str, words: str = "the of") -> DataFrame:
    base.utc(spark)
    docs = base.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "n_chars")
    hits = predicates.match_words(docs, words, ["text"]).drop("text")
    seen = enrich.with_views(hits, rollups.view_counts(base.view_events(spark, d)))
    rated = enrich.with_ratings(seen, base.rating_rows(spark, d)).where("stars = 0")
    top = ordered.top_n(rated, 10, 1, 100, [F.desc("count"), "path"])
    return top.select("path", "count", "visited", X.size_label("n_chars").alias("size"))


SQL = f"""WITH {base.EV}, {base.VIEWS}, {base.RATINGS},
hits AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of'))
SELECT h.path, coalesce(v.count, 0) AS count, coalesce(v.count, 0) > 0 AS visited,
 CASE WHEN n_chars = 0 THEN '' WHEN n_chars >= 1048576 THEN printf('%.1f MB', floor(n_chars / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.0f KB', floor(n_chars / 1024.0 + 0.5)) END AS size
FROM hits h LEFT JOIN views v ON h.path = v.path LEFT JOIN ratings r ON h.path = r.path WHERE coalesce(r.stars, 0) = 0 ORDER BY 2 DESC, 1 LIMIT 10"""
base.query("flagship", SQL)(flagship)
