"""Retrieval: exact top-k with filters, boost and merge, guards, contexts, fusion, and how well it went."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.blocks import asked_of_all
from tessella.functions.vectors import cosine, cosine_to, norm
from tessella.operators.corpus import meta
from tessella.operators.fulltext import ASKED, LEXICAL, chunk_index, search
from tessella.plans.lineage import cut
from tessella.registry import query
from tessella.sources.views import Views

#: What the stores' callers use by default: smallest score, rows of each kind, scores and numbers of images.
THRESHOLD, TEXTS, IMAGES, BOOST = 0.6, 6, 2, 0.10
IMAGE_MIN, IMAGE_MIN_ASKED, IMAGE_MAX, IMAGE_MAX_ASKED = 0.55, 0.45, 2, 3
#: The given vectors are nearly uncorrelated, so the queries below ask for less.
WIDE = {"threshold": 1.0, "texts": 60, "images": 60}

SCORED = "scored AS (SELECT c.*, filename, pages, round(list_cosine_similarity(c.embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM chunks c JOIN docs USING (doc_id), question WHERE c.embedding IS NOT NULL)"
HITS = SCORED + ", hits AS (SELECT *, row_number() OVER (PARTITION BY chunk_type ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 60)"
MERGED = HITS + """, boosted AS (SELECT * REPLACE (CASE WHEN chunk_type = 'image' THEN round(score + 0.1, 6) ELSE score END AS score) FROM hits),
    merged AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_type = 'image', rank) AS position FROM boosted)"""
GUARDED = MERGED + """, g AS (SELECT *, CASE WHEN score < 0.2 THEN 'image_score_min' WHEN doc_id NOT IN (SELECT doc_id FROM merged WHERE chunk_type = 'text') THEN 'cross_doc_id_guard' END AS r
        FROM merged WHERE chunk_type = 'image' AND coalesce(asset_path, '') <> ''),
    p AS (SELECT *, sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY position) AS passed FROM g),
    guarded AS (SELECT id, score, position, r IS NULL AND passed <= 2 AS approved, CASE WHEN passed <= 2 THEN r END AS drop_reason FROM p),
    shown AS (SELECT m.*, json_extract_string(meta, '$.content_type') IS NOT NULL AS rss FROM merged m WHERE chunk_type = 'text' OR id IN (SELECT id FROM guarded WHERE approved))"""


def scored(chunks: DataFrame, docs: DataFrame, question: DataFrame) -> DataFrame:
    """Chunks that have a vector, with their document's name and pages and the cosine to the question's one vector."""
    asked = question.first()  # one row
    rows = chunks.where("embedding IS NOT NULL" if asked else "false")
    score = cosine_to(asked["q"])(F.col("embedding")) if asked else F.lit(None).cast("double")
    return rows.withColumn("score", F.round(score, 6)).drop("embedding").join(docs.select("doc_id", "filename", "pages"), "doc_id")


def filtered(rows: DataFrame, threshold: float = THRESHOLD, doc_filter: str | None = None, source_type: str | None = None, chunk_type: str | None = None) -> DataFrame:
    """What may be retrieved: distance below the threshold, and the filters that are given."""
    out = rows.where(1 - F.col("score") < threshold)
    if doc_filter:
        out = out.where(F.col("filename").ilike(f"%{doc_filter}%"))
    if source_type:
        web = F.col("filename").startswith("http")
        out = out.where(web if source_type == "rss" else ~web)
    return out.where(F.col("chunk_type") == chunk_type) if chunk_type else out


def top(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "id").limit(k)


def dual(rows: DataFrame, texts: int = TEXTS, images: int = IMAGES) -> DataFrame:
    """The best texts and the best images, ranked apart; Spark keeps only that many of each before it shuffles."""
    rank = F.row_number().over(W.partitionBy("chunk_type").orderBy(F.desc("score"), "id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= max(texts, images))
    return few.where(F.col("rank") <= F.when(F.col("chunk_type") == "image", images).otherwise(texts))


def merged(hits: DataFrame, boost: float = 0.0) -> DataFrame:
    """Texts and images in one order: by score, texts before images of the same, then by rank. Hits are few by now."""
    image = F.col("chunk_type") == "image"
    raised = hits.withColumn("score", F.when(image, F.round(F.col("score") + boost, 6)).otherwise(F.col("score")))
    return raised.withColumn("position", F.row_number().over(W.orderBy(F.desc("score"), image, "rank")))


def guarded(hits: DataFrame, minimum: float, most: int, asked: bool = False) -> DataFrame:
    """Images with an asset: which are shown, and why others are not.

    An image below the minimum is dropped; so is, unless images were asked for, one of a document without a text hit. The
    walk ends at the first image that passes once ``most`` are shown, so those after it carry no reason.
    """
    with_text = hits.where("chunk_type = 'text'").select("doc_id").distinct().withColumn("has_text", F.lit(True))
    images = hits.where("chunk_type = 'image' AND coalesce(asset_path, '') <> ''").join(with_text, "doc_id", "left")
    reason = F.when(F.col("score") < minimum, "image_score_min")
    if not asked:
        reason = reason.when(F.col("has_text").isNull(), "cross_doc_id_guard")
    passed = F.count_if(F.col("reason").isNull()).over(W.orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    return images.withColumn("reason", reason).withColumn("passed", passed).select(
        "id", "score", "position", (F.col("reason").isNull() & (F.col("passed") <= most)).alias("approved"), F.when(F.col("passed") <= most, F.col("reason")).alias("drop_reason")
    )


def shown(hits: DataFrame, minimum: float, most: int) -> DataFrame:
    """Texts, and the images that the guards let through."""
    ok = guarded(hits, minimum, most).where("approved").select(F.col("id").alias("ok"))
    return hits.join(ok, F.col("id") == F.col("ok"), "left").where("chunk_type = 'text' OR ok IS NOT NULL").withColumn("rss", meta("content_type").isNotNull())


def _scored(v: Views) -> DataFrame:
    return scored(v.chunks, v.docs, v.question)


def _merged(v: Views) -> DataFrame:
    return merged(dual(filtered(_scored(v), WIDE["threshold"]), WIDE["texts"], WIDE["images"]), BOOST)


@query(f"WITH {SCORED} SELECT id, score FROM scored")
def cosine_score(v: Views) -> DataFrame:
    return _scored(v).select("id", "score")


@query("SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) END AS score FROM embeddings, question")
def cosine_safe(v: Views) -> DataFrame:
    """A zero vector is like nothing: its similarity is 0."""
    vectors = v.table("embeddings").withColumn("e", F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return vectors.crossJoin(F.broadcast(v.question)).select("vec_id", F.round(cosine(F.col("e"), F.col("q")), 6).alias("score"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first, round(embedding[64]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS last FROM embeddings")
def l2_normalize(v: Views) -> DataFrame:
    size = norm(F.col("embedding"))
    at = lambda i: F.round(F.expr(f"embedding[{i}]").cast("double") / size, 6)
    return v.table("embeddings").select("vec_id", at(0).alias("first"), at(63).alias("last"))


@query(f"WITH {SCORED} SELECT id, doc_id, chunk_type, score FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 60")
def vector_topk(v: Views) -> DataFrame:
    return top(filtered(_scored(v), WIDE["threshold"]), 60).select("id", "doc_id", "chunk_type", "score")


@query(f"WITH {HITS} SELECT id, chunk_type, rank, score FROM hits")
def dual_topk(v: Views) -> DataFrame:
    return dual(filtered(_scored(v), WIDE["threshold"]), WIDE["texts"], WIDE["images"]).select("id", "chunk_type", "rank", "score")


@query(f"WITH {MERGED} SELECT position, id, chunk_type, score FROM merged")
def boosted_merge(v: Views) -> DataFrame:
    return _merged(v).select("position", "id", "chunk_type", "score")


@query(f"WITH {GUARDED} SELECT id, score, approved, drop_reason FROM guarded")
def image_guard_select(v: Views) -> DataFrame:
    return guarded(_merged(v), 0.2, IMAGE_MAX).drop("position")


@query(f"""WITH {GUARDED}, lines AS (SELECT position, CASE WHEN chunk_type = 'image' THEN trim(CASE WHEN rss THEN 'Bild (' || json_extract_string(meta, '$.feed_name') || ')' ELSE 'Bild (Seite ' || page || ')' END || ': ' || coalesce(caption, '') || ' /' || asset_path)
    WHEN rss THEN 'Quelle ' || json_extract_string(meta, '$.feed_name') || ' - "' || json_extract_string(meta, '$.title') || '": ' || content_text ELSE 'Text (Seite ' || page || '): ' || content_text END AS line FROM shown)
    SELECT row_number() OVER (ORDER BY position) - 1 AS n, sha256(line) AS line_sha, length(line) AS chars FROM lines""")
def context_lines(v: Views) -> DataFrame:
    feed, title = F.coalesce(meta("feed_name"), F.lit("RSS")), F.coalesce(meta("title"), F.lit(""))
    page = F.col("page").cast("string")
    where = F.when(F.col("rss"), F.concat(F.lit("Bild ("), feed, F.lit(")"))).otherwise(F.concat(F.lit("Bild (Seite "), page, F.lit(")")))
    text = F.coalesce("content_text", F.lit(""))
    line = (
        F.when(F.col("chunk_type") == "image", F.trim(F.concat(where, F.lit(": "), F.coalesce("caption", F.lit("")), F.lit(" /"), "asset_path")))
        .when(F.col("rss"), F.concat(F.lit("Quelle "), feed, F.lit(' - "'), title, F.lit('": '), text))
        .otherwise(F.concat(F.lit("Text (Seite "), page, F.lit("): "), text))
    )
    n = F.row_number().over(W.orderBy("position")) - 1
    return shown(_merged(v), 0.2, IMAGE_MAX).withColumn("line", line).select(n.alias("n"), F.sha2("line", 256).alias("line_sha"), F.length("line").alias("chars"))


@query(f"WITH {GUARDED} SELECT count(*) AS parts, sum(length(coalesce(content_text, caption)))::BIGINT AS chars, (sum(length(coalesce(content_text, caption))) // 4)::BIGINT AS tokens FROM shown")
def context_size(v: Views) -> DataFrame:
    chars = F.sum(F.length(F.coalesce("content_text", "caption")))
    return shown(_merged(v), 0.2, IMAGE_MAX).agg(F.count("*").alias("parts"), chars.alias("chars"), F.floor(chars / 4).alias("tokens"))


@query(f"""WITH {GUARDED}, keyed AS (SELECT position, page, filename, rss, json_extract_string(meta, '$.feed_name') AS feed, left(json_extract_string(meta, '$.title'), 60) AS title, json_extract_string(meta, '$.url') AS url,
        CASE WHEN NOT rss THEN filename || ':' || page WHEN json_extract_string(meta, '$.url') <> '' THEN json_extract_string(meta, '$.url') ELSE '#' || position END AS key FROM shown),
    firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY rss, key ORDER BY position) = 1)
    SELECT row_number() OVER (ORDER BY position) AS n, CASE WHEN rss AND url <> '' THEN '[' || feed || ': ' || title || '](' || url || ')' WHEN rss THEN feed || ': ' || title
    ELSE '[' || replace(replace(filename, '.pdf', ''), '_', ' ') || ' — Seite ' || page || '](https://assets.example.com/pdf/' || filename || '#page=' || page || ')' END AS source FROM firsts QUALIFY n <= 8""")
def source_list(v: Views, base: str = "https://assets.example.com", most: int = 8) -> DataFrame:
    """What the context quotes, each once: by URL, or by file and page. A feed's text without URL is never a repeat."""
    url, page = F.coalesce(meta("url"), F.lit("")), F.col("page").cast("string")
    key = F.when(~F.col("rss"), F.concat("filename", F.lit(":"), page)).when(url != "", url).otherwise(F.concat(F.lit("#"), "position"))
    quoted = F.replace(F.replace(F.url_encode("filename"), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    label = F.concat(F.coalesce(meta("feed_name"), F.lit("RSS")), F.lit(": "), F.left(F.coalesce(meta("title"), F.lit("")), F.lit(60)))
    name = F.replace(F.replace("filename", F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit(" "))
    source = (
        F.when(F.col("rss") & (url != ""), F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")")))
        .when(F.col("rss"), label)
        .otherwise(F.concat(F.lit("["), name, F.lit(" — Seite "), page, F.lit(f"]({base}/pdf/"), quoted, F.lit("#page="), page, F.lit(")")))
    )
    first = F.row_number().over(W.partitionBy("rss", "key").orderBy("position"))
    n = F.row_number().over(W.orderBy("position"))
    return shown(_merged(v), 0.2, IMAGE_MAX).select("position", "rss", key.alias("key"), source.alias("source")).withColumn("first", first).where("first = 1").select(n.alias("n"), "source").where(F.col("n") <= most)


@query(f"WITH {SCORED}, t AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 40) SELECT id, score FROM t WHERE score >= 0.15")
def topk_then_filter(v: Views) -> DataFrame:
    """The limit comes before the threshold."""
    return top(_scored(v), 40).where("score >= 0.15").select("id", "score")


@query(f"WITH {SCORED} SELECT id, score FROM scored WHERE score > 0 AND doc_id IN (SELECT doc_id FROM docs WHERE filename ILIKE '%en%') ORDER BY score DESC, id LIMIT 12")
def topk_semijoin(v: Views) -> DataFrame:
    wanted = v.docs.where(F.col("filename").ilike("%en%")).select("doc_id")
    return top(filtered(_scored(v), WIDE["threshold"]).join(wanted, "doc_id", "left_semi"), 12).select("id", "score")


@query(f"""WITH {HITS}, best AS (SELECT max(score) FILTER (chunk_type = 'text') AS b FROM hits), votes AS (SELECT doc_id, count(*) AS n FROM hits WHERE chunk_type = 'text' GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 1)
    SELECT id, score, score >= round(0.6 * b, 6) AS near_best, doc_id = (SELECT doc_id FROM votes) AS of_majority FROM hits, best WHERE chunk_type = 'image'""")
def relative_image_threshold(v: Views) -> DataFrame:
    """Images against the best text's score, and whether they are of the document with most text hits."""
    hits = dual(filtered(_scored(v), WIDE["threshold"]), WIDE["texts"], WIDE["images"])
    texts = hits.where("chunk_type = 'text'")
    best = texts.agg(F.max("score").alias("b"))
    major = texts.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(1).select(F.col("doc_id").alias("major"))
    images = hits.where("chunk_type = 'image'").crossJoin(F.broadcast(best)).crossJoin(F.broadcast(major))  # one row each
    return images.select("id", "score", (F.col("score") >= F.round(0.6 * F.col("b"), 6)).alias("near_best"), (F.col("doc_id") == F.col("major")).alias("of_majority"))


@query("""WITH p AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS n FROM documents WHERE doc_id % 2 = 1),
    c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS own FROM p) , k AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS total FROM c WHERE own <= 20)
    SELECT source, doc_id FROM k WHERE total <= 45""")
def global_cap(v: Views, each: int = 20, whole: int = 45) -> DataFrame:
    """Up to ``each`` new articles of a feed, feed after feed, until ``whole`` are taken."""
    own = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    new = v.table("documents").where("doc_id % 2 = 1").select("source", "doc_id").withColumn("own", own).where(F.col("own") <= each)
    return new.select("source", "doc_id").orderBy("source", "doc_id").limit(whole)


@query("SELECT id, chunk_type FROM chunks ORDER BY md5(id || ':7') LIMIT 5")
def seeded_sample(v: Views, seed: int = 7, n: int = 5) -> DataFrame:
    """A sample that a seed fixes, whatever the partitions."""
    return v.chunks.select("id", "chunk_type").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")).cast("binary"))).limit(n)


FUSED = f"""{SCORED}, dense AS (SELECT id, page, row_number() OVER (ORDER BY score DESC, id) AS dense_rank FROM scored WHERE chunk_type = 'text' QUALIFY dense_rank <= 200), {LEXICAL},
    fused AS (SELECT id, dense_rank, lexical_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0.0), 9) AS rrf FROM dense FULL JOIN lexical USING (id))"""


def fused(dense: DataFrame, lex: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return dense.join(lex, "id", "full").select("id", "dense_rank", "lexical_rank", F.round(part("dense_rank") + part("lexical_rank"), 9).alias("rrf"))


def _fused(v: Views) -> DataFrame:
    best = top(_scored(v).where("chunk_type = 'text'"), 200)
    dense = best.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("dense_rank"))
    return fused(dense, search(chunk_index(v), ASKED).select("id", "lexical_rank"))


@query(f"WITH {FUSED} SELECT id, dense_rank, lexical_rank, rrf FROM fused ORDER BY rrf DESC, id LIMIT 20")
def rrf_fusion(v: Views) -> DataFrame:
    return _fused(v).orderBy(F.desc("rrf"), "id").limit(20)


@query(f"WITH {FUSED}, p AS (SELECT f.id, c.page, round(rrf * CASE WHEN c.page <= 2 OR c.page >= 11 THEN 0.5 ELSE 1.0 END, 9) AS rrf FROM fused f JOIN chunks c USING (id)) SELECT id, page, rrf, row_number() OVER (ORDER BY rrf DESC, id) AS rank FROM p QUALIFY rank <= 20")
def penalized_rrf(v: Views, first: int = 2, last: int = 11, factor: float = 0.5) -> DataFrame:
    """Front and back pages count half; ranks follow."""
    edge = (F.col("page") <= first) | (F.col("page") >= last)
    paged = _fused(v).join(v.chunks.select("id", "page"), "id").select("id", "page", F.round(F.col("rrf") * F.when(edge, factor).otherwise(1.0), 9).alias("rrf"))
    return paged.orderBy(F.desc("rrf"), "id").limit(20).withColumn("rank", F.row_number().over(W.orderBy(F.desc("rrf"), "id")))


@query(f"WITH {FUSED} SELECT h.id, f.dense_rank, f.lexical_rank, f.rrf, CASE WHEN f.id IS NULL THEN 'dense' WHEN f.lexical_rank IS NOT NULL THEN 'hybrid' ELSE 'hybrid_legacy' END AS mode FROM (SELECT id FROM chunks WHERE label = 0) h LEFT JOIN fused f USING (id)")
def hybrid_extras(v: Views) -> DataFrame:
    both = _fused(v).withColumn("known", F.lit(True))
    mode = F.when(F.col("known").isNull(), "dense").when(F.col("lexical_rank").isNotNull(), "hybrid").otherwise("hybrid_legacy")
    return v.chunks.where("label = 0").select("id").join(both, "id", "left").select("id", "dense_rank", "lexical_rank", "rrf", mode.alias("mode"))


@query(f"""WITH {MERGED} SELECT position, id, round(score, 4) AS score, round(1 - score, 4) AS distance, left(coalesce(content_text, caption), CASE WHEN chunk_type = 'image' THEN 200 ELSE 300 END) AS preview,
    filename LIKE 'http%' AS is_rss, filename NOT LIKE 'http%' AND lower(filename) LIKE '%.pdf' AS is_pdf FROM merged""")
def candidate_summary(v: Views) -> DataFrame:
    web = F.col("filename").startswith("http")
    preview = F.when(F.col("chunk_type") == "image", F.left("caption", F.lit(200))).otherwise(F.left("content_text", F.lit(300)))
    return _merged(v).select("position", "id", F.round("score", 4).alias("score"), F.round(1 - F.col("score"), 4).alias("distance"), preview.alias("preview"), web.alias("is_rss"), (~web & F.lower("filename").endswith(".pdf")).alias("is_pdf"))


#: What headings call lists of contents and back matter (fixed values).
FRONT_MARKERS = ("inhaltsverzeichnis",)
BACK_MARKERS = ("stichwortverzeichnis", "impressum", "index")


def matter(page: Column, pages: Column, heading: Column) -> tuple[Column, Column, Column]:
    """Front matter, back matter, and the reasons. A short document's pages can be both."""
    low = F.lower(F.coalesce(heading, F.lit("")))
    holds = lambda marks: F.coalesce(low.rlike("|".join(marks)), F.lit(False))
    known = F.when(pages > 0, pages)
    first = F.coalesce(page <= 10, F.lit(False))
    last = F.coalesce(known.isNotNull() & (page >= F.greatest(F.lit(1), known - 10)), F.lit(False))
    far = F.coalesce(known.isNull() & (page >= 320), F.lit(False))
    toc = holds(FRONT_MARKERS) | holds(BACK_MARKERS)
    reasons = F.array_compact(F.array(F.when(first, "page_in_first_10"), F.when(last, "page_in_last_10"), F.when(far, "page_fallback_gte_320"), F.when(toc, "heading_path_contains_toc")))
    return first | holds(FRONT_MARKERS), last | far | holds(BACK_MARKERS), reasons


@query("""WITH f AS (SELECT c.id, c.page, pages, lower(coalesce(json_extract_string(c.meta, '$.heading_path'), '')) AS h FROM chunks c JOIN docs USING (doc_id))
    SELECT id, page <= 10 OR contains(h, 'inhaltsverzeichnis') AS front, page >= greatest(1, pages - 10) OR contains(h, 'stichwortverzeichnis') OR contains(h, 'impressum') OR contains(h, 'index') AS back,
    concat_ws(',', CASE WHEN page <= 10 THEN 'page_in_first_10' END, CASE WHEN page >= greatest(1, pages - 10) THEN 'page_in_last_10' END, CASE WHEN contains(h, 'inhaltsverzeichnis') OR contains(h, 'stichwortverzeichnis') OR contains(h, 'impressum') OR contains(h, 'index') THEN 'heading_path_contains_toc' END) AS reasons FROM f""")
def matter_flags(v: Views) -> DataFrame:
    front, back, reasons = matter(F.col("page"), F.col("pages"), meta("heading_path"))
    return v.chunks.join(v.docs.select("doc_id", "pages"), "doc_id").select("id", front.alias("front"), back.alias("back"), F.array_join(reasons, ",").alias("reasons"))


@query(f"WITH {HITS} SELECT k, count(*) FILTER (page <= 10) AS front, count(*) FILTER (page >= greatest(1, pages - 10)) AS back FROM hits, (VALUES (5), (10), (20)) t(k) WHERE chunk_type = 'text' AND rank <= k GROUP BY k")
def front_back_counts(v: Views) -> DataFrame:
    hits = dual(filtered(_scored(v), WIDE["threshold"]), WIDE["texts"], WIDE["images"]).where("chunk_type = 'text'")
    front, back, _ = matter(F.col("page"), F.col("pages"), F.lit(None).cast("string"))
    cuts = hits.withColumn("k", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20)))).where("rank <= k")
    return cuts.groupBy("k").agg(F.count_if(front).alias("front"), F.count_if(back).alias("back"))


@query(f"""WITH {HITS} SELECT chunk_type, count(*) AS n, round(100.0 * count(*) FILTER (json_extract_string(meta, '$.heading_path') IS NOT NULL) / count(*), 1) AS heading_pct, round(100.0 * count(*) FILTER (json_exists(meta, '$.note')) / count(*), 1) AS note_pct,
    round(100.0 * count(*) FILTER (json_extract_string(meta, '$.heading_path') IS NULL AND NOT json_exists(meta, '$.note')) / count(*), 1) AS missing_pct FROM hits GROUP BY 1""")
def structural_coverage(v: Views) -> DataFrame:
    heading, note = meta("heading_path").isNotNull(), F.array_contains(F.json_object_keys("meta"), "note")
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 1)
    hits = dual(filtered(_scored(v), WIDE["threshold"]), WIDE["texts"], WIDE["images"])
    return hits.groupBy("chunk_type").agg(F.count("*").alias("n"), pct(heading).alias("heading_pct"), pct(note).alias("note_pct"), pct(~heading & ~note).alias("missing_pct"))


PROMPTS = """prompts AS (SELECT vec_id AS prompt, embedding AS pq, label AS plabel FROM embeddings WHERE vec_id % 100 = 0),
    gold AS (SELECT prompt, id FROM prompts JOIN chunks ON id // 100 = prompt // 100 AND id <> prompt AND abs(label - plabel) <= 2),
    ps AS (SELECT prompt, id, chunk_type, round(list_cosine_similarity(embedding::DOUBLE[], pq::DOUBLE[]), 6) AS score FROM chunks, prompts WHERE embedding IS NOT NULL AND id <> prompt),
    pr AS (SELECT *, row_number() OVER (PARTITION BY prompt, chunk_type ORDER BY score DESC, id) AS r FROM ps QUALIFY r <= CASE WHEN chunk_type = 'image' THEN 20 ELSE 60 END),
    cand AS (SELECT prompt, id, chunk_type, score, row_number() OVER (PARTITION BY prompt ORDER BY chunk_type = 'image', r) AS rank FROM pr)"""


def best_of_all(prompts: DataFrame, chunks: DataFrame, texts: int, images: int) -> DataFrame:
    """``(prompt, id, chunk_type, score, r)``: for each of ``prompts`` (prompt, pq) the best texts and images of all chunks but itself.

    Prompts meet chunks in blocks; a pair of blocks gives no more than the best of each kind, and a window merges them.
    """

    def found(a: np.ndarray, b: np.ndarray, image: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        parts = []
        for kind, most in ((False, texts), (True, images)):
            at = np.flatnonzero(image == kind)
            at = at[np.argsort(b[at], kind="stable")]
            for i, prompt in enumerate(a):
                own = at[b[at] != prompt]
                top_ = own[np.argsort(-c[i, own], kind="stable")[:most]]
                parts.append(pd.DataFrame({"prompt": prompt, "id": b[top_], "image": kind, "score": c[i, top_]}))
        return pd.concat(parts)

    rows = chunks.where("embedding IS NOT NULL").select("id", F.col("embedding").alias("v"), (F.col("chunk_type") == "image").alias("flag"))
    near = asked_of_all(prompts.select(F.col("prompt").alias("id"), F.col("pq").alias("v")), rows, found, "prompt long, id long, image boolean, score double")
    rank = F.row_number().over(W.partitionBy("prompt", "image").orderBy(F.desc("score"), "id"))
    kept = near.withColumn("r", rank).where(F.col("r") <= F.when(F.col("image"), images).otherwise(texts))
    return kept.select("prompt", "id", F.when(F.col("image"), "image").otherwise("text").alias("chunk_type"), "score", "r")


def _prompts(v: Views) -> DataFrame:
    """Every vector whose id is divisible by 100 asks."""
    return v.table("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("prompt"), F.col("embedding").alias("pq"), F.col("label").alias("plabel"))


def _candidates(v: Views) -> tuple[DataFrame, DataFrame]:
    """Gold chunks (of a like label, among the hundred from the prompt on) and ranked candidates of all prompts: texts first, then images."""
    prompts = _prompts(v)
    near = prompts.select("prompt", "plabel", F.expr("prompt div 100").alias("hundred"))
    gold = v.chunks.select("id", "label", F.expr("id div 100").alias("hundred")).join(near, "hundred").where("id <> prompt AND abs(label - plabel) <= 2").select("prompt", "id")
    order = F.row_number().over(W.partitionBy("prompt").orderBy(F.col("chunk_type") == "image", "r"))
    return gold, best_of_all(prompts, v.chunks, 60, 20).select("prompt", "id", "chunk_type", "score", order.alias("rank"))


@query(f"""WITH {PROMPTS} SELECT g.prompt, count(*) AS n_gold, round(count(*) FILTER (rank <= 1) / count(*), 6) AS recall_1, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5,
    round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10, round(count(*) FILTER (rank <= 20) / count(*), 6) AS recall_20, round(coalesce(1.0::DOUBLE / min(rank), 0.0), 6) AS mrr, coalesce(bool_or(rank <= 6), false) AS reached_final
    FROM gold g LEFT JOIN cand c ON g.prompt = c.prompt AND g.id = c.id GROUP BY g.prompt""")
def recall_mrr(v: Views) -> DataFrame:
    gold, ranked = _candidates(v)
    n = F.count("*")
    recall = lambda k: F.round(F.count_if(F.col("rank") <= k) / n, 6).alias(f"recall_{k}")
    return gold.join(ranked, ["prompt", "id"], "left").groupBy("prompt").agg(n.alias("n_gold"), *map(recall, (1, 5, 10, 20)), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"), F.coalesce(F.bool_or(F.col("rank") <= 6), F.lit(False)).alias("reached_final"))


@query(f"""WITH {PROMPTS} SELECT g.prompt, g.id, c.rank, c.id IS NOT NULL AS in_candidates, coalesce(c.rank <= 6, false) AS in_final, ch.embedding IS NOT NULL AS has_embedding
    FROM gold g LEFT JOIN cand c ON g.prompt = c.prompt AND g.id = c.id JOIN chunks ch ON g.id = ch.id""")
def cross_reference(v: Views) -> DataFrame:
    gold, ranked = _candidates(v)
    rows = gold.join(ranked, ["prompt", "id"], "left").join(v.chunks.select("id", F.col("embedding").isNotNull().alias("has_embedding")), "id")
    return rows.select("prompt", "id", "rank", F.col("rank").isNotNull().alias("in_candidates"), F.coalesce(F.col("rank") <= 6, F.lit(False)).alias("in_final"), "has_embedding")


@query(f"""WITH {PROMPTS}, x AS (SELECT g.prompt, count(*) AS n, count(*) FILTER (ch.embedding IS NOT NULL) AS e, count(*) FILTER (c.id IS NOT NULL) AS c, count(*) FILTER (c.rank <= 6) AS f FROM gold g LEFT JOIN cand c ON g.prompt = c.prompt AND g.id = c.id JOIN chunks ch ON g.id = ch.id GROUP BY 1)
    SELECT p.prompt, CASE WHEN n IS NULL THEN 'missing_chunk' WHEN e = 0 THEN 'missing_embedding' WHEN p.prompt % 500 = 0 THEN 'unknown_due_to_insufficient_evidence' WHEN c = 0 THEN 'low_rank' WHEN f = 0 THEN 'context_packing' ELSE 'generation' END AS class FROM prompts p LEFT JOIN x USING (prompt)""")
def classify_failure(v: Views) -> DataFrame:
    """Where the evidence for a prompt was lost: never stored, never embedded, unknown, ranked low, not packed, or not used."""
    gold, ranked = _candidates(v)
    rows = gold.join(ranked, ["prompt", "id"], "left").join(v.chunks.select("id", F.col("embedding").isNotNull().alias("has")), "id")
    counts = rows.groupBy("prompt").agg(F.count("*").alias("n"), F.count_if("has").alias("e"), F.count("rank").alias("c"), F.count_if(F.col("rank") <= 6).alias("f"))
    kind = (
        F.when(F.col("n").isNull(), "missing_chunk").when(F.col("e") == 0, "missing_embedding").when(F.col("prompt") % 500 == 0, "unknown_due_to_insufficient_evidence")
        .when(F.col("c") == 0, "low_rank").when(F.col("f") == 0, "context_packing").otherwise("generation")
    )
    return _prompts(v).select("prompt").join(counts, "prompt", "left").select("prompt", kind.alias("class"))


@query("""WITH g AS (SELECT vec_id // 100 AS h, label, array_agg(vec_id ORDER BY vec_id) AS ids FROM embeddings WHERE label <> 9 GROUP BY 1, 2), j AS (SELECT 'p' || h || 'x' || label || '_v1' AS k, ids FROM g)
    SELECT split_part(k, '_', 1) AS prompt, k AS full_id, unnest(ids) AS chunk_id FROM j""")
def gold_unnest(v: Views) -> DataFrame:
    """Gold files, read as maps of prompts; a prompt without gold ids falls out. A file holds the ids of one label in a hundred."""
    rows = v.table("embeddings").groupBy(F.expr("vec_id div 100").alias("h"), "label").agg(F.array_join(F.array_sort(F.collect_list("vec_id")), ",").alias("ids"))
    entry = F.when(F.col("label") == 9, F.lit('{"query":"none"}')).otherwise(F.concat(F.lit('{"query":"q","gold_chunk_ids":['), "ids", F.lit("]}")))
    files = rows.select(F.concat(F.lit('{"p'), "h", F.lit("x"), "label", F.lit('_v1":'), entry, F.lit("}")).alias("json"))
    gold = files.select(F.explode(F.from_json("json", "map<string,struct<query:string,gold_chunk_ids:array<bigint>>>")).alias("full_id", "g")).where("g.gold_chunk_ids IS NOT NULL")
    return gold.select(F.split_part("full_id", F.lit("_"), F.lit(1)).alias("prompt"), "full_id", F.explode("g.gold_chunk_ids").alias("chunk_id"))


#: Characters of the needles that one pass over the texts looks for: what each task holds and is sent.
NEEDLE_CHARS = 1 << 22


def without_filter(text: Column) -> Column:
    """A question without the ``@name`` in front of it."""
    return F.when(text.startswith("@") & (F.instr(text, " ") > 0), F.substr(text, F.instr(text, " ") + 1)).otherwise(text)


def containing(needles: DataFrame, texts: DataFrame, part_chars: int = NEEDLE_CHARS) -> DataFrame:
    """``(needle, id)`` for each of the distinct ``needles`` and each of ``texts`` (id, body) that contains it, exactly.

    Needles go in parts of about ``part_chars`` characters, dealt by a hash. For each part, tasks read the texts once through
    an Aho-Corasick automaton of its needles, so a text is walked once however many needles there are. No text is shuffled; rows
    that leave a task are hits. Null and empty needles are in none, null texts hold none; rows that repeat an id are one.
    """
    wanted = cut(needles.select("needle").distinct().where("needle <> ''"))
    chars = wanted.agg(F.sum(F.length("needle")).alias("n")).first()["n"] or 0
    parts = -(-chars // part_chars)
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.sparkSession.createDataFrame([], f"needle string, id {kind}")
    for p in range(parts):
        held = sorted(r["needle"] for r in wanted.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == p).collect())

        def hits(batches: Iterator[pd.DataFrame], held: list[str] = held) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for n, needle in enumerate(held):
                automaton.add_word(needle, n)
            if held:
                automaton.make_automaton()
            for batch in batches:
                at = [(held[n], i) for i, body in zip(batch["id"], batch["body"], strict=True) if held for n in sorted({n for _, n in automaton.iter(body)})]
                yield pd.DataFrame(at, columns=["needle", "id"])

        found = found.union(texts.select("id", "body").where("body IS NOT NULL").mapInPandas(hits, f"needle string, id {kind}"))
    return found.distinct()


def _questions(v: Views) -> tuple[DataFrame, DataFrame]:
    """Prompts, some with a filter in front, and traces (id, body, stamp) that hold the questions with words around them."""
    first = v.table("conversations").where("turn = 0")
    prompt = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("@rss "), "text")).when(F.col("conv_id") % 4 == 1, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    body = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Please: "), "text", F.lit(" Thanks."))).otherwise(F.col("text"))
    stamp = F.concat(F.lit("2024-01-0"), 1 + F.col("conv_id") % 7)
    return first.select(F.col("conv_id").alias("prompt"), prompt.alias("query")), first.select(F.col("conv_id").alias("id"), F.lower(body).alias("body"), stamp.alias("stamp"))


ASKS = """p AS (SELECT conv_id AS prompt, CASE conv_id % 4 WHEN 0 THEN '@rss ' || text WHEN 1 THEN ' ' || text ELSE text END AS query FROM conversations WHERE turn = 0),
    t AS (SELECT conv_id AS id, lower(CASE WHEN conv_id % 3 = 0 THEN 'Please: ' || text || ' Thanks.' ELSE text END) AS body, '2024-01-0' || (1 + conv_id % 7) AS stamp FROM conversations WHERE turn = 0)"""


@query(f"""WITH {ASKS}, n AS (SELECT prompt, left(trim(CASE WHEN starts_with(lower(query), '@') AND strpos(query, ' ') > 0 THEN lower(query)[strpos(query, ' ') + 1:] ELSE lower(query) END), 60) AS needle FROM p),
    h AS (SELECT prompt, min(id) AS trace, count(*) AS n FROM n JOIN t ON needle <> '' AND contains(body, needle) GROUP BY 1) SELECT prompt, trace FROM h WHERE n = 1""")
def match_traces(v: Views) -> DataFrame:
    """A prompt's trace: the one that contains its first 60 characters, without a filter in front, if exactly one does."""
    prompts, traces = _questions(v)
    asked = prompts.select("prompt", F.left(F.trim(without_filter(F.lower("query"))), F.lit(60)).alias("needle"))
    one = containing(asked, traces.select("id", "body")).groupBy("needle").agg(F.min("id").alias("trace"), F.count("*").alias("n")).where("n = 1")
    return asked.join(one, "needle").select("prompt", "trace")


@query(f"""WITH {ASKS}, n AS (SELECT prompt, trim(left(lower(CASE WHEN starts_with(trim(query), '@') AND strpos(trim(query), ' ') > 0 THEN trim(query)[strpos(trim(query), ' ') + 1:] ELSE trim(query) END), 60)) AS needle FROM p)
    SELECT prompt, count(*) AS matches, max_by(id, stamp || lpad(id::VARCHAR, 12, '0')) AS trace FROM n JOIN t ON needle <> '' AND contains(body, needle) GROUP BY 1""")
def latest_match(v: Views) -> DataFrame:
    """Of all traces that contain a prompt's beginning, the one with the latest time, the last of equal ones."""
    prompts, traces = _questions(v)
    asked = prompts.select("prompt", F.trim(F.left(F.lower(without_filter(F.trim("query"))), F.lit(60))).alias("needle"))
    hits = containing(asked, traces.select("id", "body")).join(traces.select("id", "stamp"), "id")
    last = hits.groupBy("needle").agg(F.count("*").alias("matches"), F.max_by("id", F.struct("stamp", "id")).alias("trace"))
    return asked.join(last, "needle").select("prompt", "matches", "trace")
