"""The retrieval tables, as views of the given tables: documents, chunks with vectors, feeds, polls."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EPOCH = 1704067200  # 2024-01-01 UTC

_schemas: dict[tuple[str, str], StructType] = {}


class Views:
    """``docs`` and ``chunks`` as a store of an ingested corpus would hold them; the other tables as they are.

    Four vectors make a document's chunks, the first of most documents an image. Every 17th chunk has lost its vector.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A table; its schema is read from a file once a session, as that is a job of its own."""
        path = f"{self.sf_dir}/{name}.parquet"
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _schemas:
            _schemas[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[key]).parquet(path)

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id",
            "CASE WHEN doc_id % 3 = 0 THEN concat('https://', source, '.example.com/', lang, '/', doc_id) ELSE concat(source, '_', lang, '_', doc_id, '.pdf') END AS filename",
            "sha2(text, 256) AS sha256",
            "lang",
            "1 + n_chars div 1500 AS pages",
            f"{EPOCH} + doc_id AS created_at",
            "text",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        image = "(vec_id % 4 = 0 AND (vec_id div 4) % 5 <> 1)"
        lost = "(vec_id % 17 = 0 AND vec_id <> 0)"
        return (
            self.table("embeddings")
            .withColumn("d", F.expr("vec_id div 4"))
            .join(self.table("documents"), F.col("d") == F.col("doc_id"))
            .selectExpr(
                "vec_id AS id",
                "doc_id",
                f"CASE WHEN {image} THEN 'image' ELSE 'text' END AS chunk_type",
                "1 + vec_id % 12 AS page",
                f"CASE WHEN NOT {image} THEN text END AS content_text",
                f"CASE WHEN {image} THEN CASE WHEN vec_id % 24 = 0 THEN '' ELSE left(text, 200) END END AS caption",
                f"CASE WHEN {image} THEN concat('assets/', vec_id % 40, '.jpg') END AS asset_path",
                f"CASE WHEN NOT {lost} THEN embedding END AS embedding",
                "label",
                "concat('{\"source\":\"', CASE WHEN doc_id % 3 = 0 THEN 'rss_article' ELSE 'pdf_text' END, '\",\"page\":', 1 + vec_id % 12, "
                "CASE WHEN doc_id % 3 = 0 THEN concat(',\"content_type\":\"rss_article\",\"url\":\"', CASE WHEN vec_id % 2 = 0 THEN concat('https://news.example.com/', doc_id) ELSE '' END, '\",\"title\":\"T', doc_id, '\",\"feed_name\":\"', source, '\"') ELSE '' END, "
                "CASE WHEN vec_id % 5 = 0 THEN concat(',\"heading_path\":\"Kapitel ', vec_id % 7, CASE WHEN vec_id % 35 = 0 THEN ' Index' ELSE '' END, '\"') ELSE '' END, "
                "CASE WHEN vec_id % 9 = 0 THEN ',\"note\":null' ELSE '' END, "
                f"CASE WHEN {lost} THEN ',\"embedding_error\":\"embed_failed\"' ELSE '' END, '}}') AS meta",
            )
        )

    @cached_property
    def question(self) -> DataFrame:
        """One row: the vector that retrieval is asked with."""
        return self.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


_IMAGE = "(vec_id % 4 = 0 AND (vec_id // 4) % 5 <> 1)"
_LOST = "(vec_id % 17 = 0 AND vec_id <> 0)"
#: The same views as common table expressions.
VIEWS_SQL = f"""
docs AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://' || source || '.example.com/' || lang || '/' || doc_id ELSE source || '_' || lang || '_' || doc_id || '.pdf' END AS filename,
    sha256(text) AS sha256, lang, 1 + n_chars // 1500 AS pages, {EPOCH} + doc_id AS created_at, text FROM documents),
chunks AS (SELECT vec_id AS id, doc_id, CASE WHEN {_IMAGE} THEN 'image' ELSE 'text' END AS chunk_type, 1 + vec_id % 12 AS page,
    CASE WHEN NOT {_IMAGE} THEN text END AS content_text,
    CASE WHEN {_IMAGE} THEN CASE WHEN vec_id % 24 = 0 THEN '' ELSE left(text, 200) END END AS caption,
    CASE WHEN {_IMAGE} THEN 'assets/' || (vec_id % 40) || '.jpg' END AS asset_path,
    CASE WHEN NOT {_LOST} THEN embedding END AS embedding, label,
    '{{"source":"' || CASE WHEN doc_id % 3 = 0 THEN 'rss_article' ELSE 'pdf_text' END || '","page":' || (1 + vec_id % 12)
    || CASE WHEN doc_id % 3 = 0 THEN ',"content_type":"rss_article","url":"' || CASE WHEN vec_id % 2 = 0 THEN 'https://news.example.com/' || doc_id ELSE '' END || '","title":"T' || doc_id || '","feed_name":"' || source || '"' ELSE '' END
    || CASE WHEN vec_id % 5 = 0 THEN ',"heading_path":"Kapitel ' || (vec_id % 7) || CASE WHEN vec_id % 35 = 0 THEN ' Index' ELSE '' END || '"' ELSE '' END
    || CASE WHEN vec_id % 9 = 0 THEN ',"note":null' ELSE '' END
    || CASE WHEN {_LOST} THEN ',"embedding_error":"embed_failed"' ELSE '' END || '}}' AS meta
    FROM embeddings JOIN documents ON vec_id // 4 = doc_id),
question AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
""".strip()
