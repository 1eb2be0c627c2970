"""Corpus analytics: counts, cohorts, integrity, listings and joins of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.registry import query
from tessella.sources.views import EPOCH, Views


def meta(key: str) -> Column:
    """A metadata value as text; null if the key is absent or holds null."""
    return F.get_json_object("meta", f"$.{key}")


def has_key(key: str) -> Column:
    """True if a metadata key exists, even if it holds null."""
    return F.array_contains(F.json_object_keys("meta"), key)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage, null where there is nothing to share."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits))


@query("SELECT * FROM (SELECT 'docs' AS name, count(*) AS n FROM docs UNION ALL SELECT 'chunks', count(*) FROM chunks)")
def table_counts(v: Views) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count(v.docs, "docs").union(count(v.chunks, "chunks"))


@query("SELECT filename, pages FROM docs WHERE lower(filename) LIKE '%.pdf' ORDER BY filename LIMIT 25")
def scan_docs_sorted(v: Views) -> DataFrame:
    return v.docs.where(F.lower("filename").endswith(".pdf")).select("filename", "pages").orderBy("filename").limit(25)


@query(r"SELECT doc_id, filename FROM docs WHERE filename ILIKE '%src_\_en%' ESCAPE '\'")
def doc_filter_ilike(v: Views) -> DataFrame:
    """In the pattern ``_`` stands for any one character; a literal one is escaped."""
    return v.docs.where(F.col("filename").ilike("%src_\\_en%")).select("doc_id", "filename")


@query("SELECT CASE WHEN filename LIKE 'http%' THEN 'rss' ELSE 'pdf' END AS source_type, count(*) AS n FROM docs GROUP BY 1")
def source_split(v: Views) -> DataFrame:
    return v.docs.groupBy(F.when(F.col("filename").startswith("http"), "rss").otherwise("pdf").alias("source_type")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (json_exists(meta, '$.note')) AS has_note, count(*) FILTER (json_extract_string(meta, '$.note') IS NOT NULL) AS note_set,
    count(*) FILTER (json_exists(meta, '$.heading_path')) AS has_heading FROM chunks""")
def meta_key_exists(v: Views) -> DataFrame:
    return v.chunks.agg(F.count_if(has_key("note")).alias("has_note"), F.count_if(meta("note").isNotNull()).alias("note_set"), F.count_if(has_key("heading_path")).alias("has_heading"))


@query("""SELECT id, json_extract_string(meta, '$.source') AS source, json_extract_string(meta, '$.page')::INT AS page,
    json_extract_string(meta, '$.feed_name') AS feed_name FROM chunks""")
def json_extract(v: Views) -> DataFrame:
    return v.chunks.select("id", meta("source").alias("source"), meta("page").cast("int").alias("page"), meta("feed_name").alias("feed_name"))


@query("SELECT id, doc_id, page FROM chunks WHERE (content_text ILIKE '%tion%' OR content_text ILIKE '%the%' OR caption ILIKE '%tion%' OR caption ILIKE '%the%')")
def multi_term_search(v: Views, terms: tuple[str, ...] = ("tion", "the"), doc_id: int | None = None) -> DataFrame:
    """Chunks with any of the terms in text or caption, of all documents or of one."""
    rows = v.chunks if doc_id is None else v.chunks.where(F.col("doc_id") == doc_id)
    found = F.lit(False)
    for term in terms:
        found = found | F.coalesce(F.col("content_text").ilike(f"%{term}%"), F.lit(False)) | F.coalesce(F.col("caption").ilike(f"%{term}%"), F.lit(False))
    return rows.where(found).select("id", "doc_id", "page")


@query("""WITH hits AS (SELECT DISTINCT doc_id, page FROM chunks WHERE label = 3)
    SELECT DISTINCT c.id, c.doc_id, c.page FROM chunks c JOIN hits h ON c.doc_id = h.doc_id AND c.page BETWEEN h.page - 1 AND h.page + 1""")
def neighbor_pages(v: Views) -> DataFrame:
    """Chunks on the pages of a hit and next to them. Pages are numbers, so neighbours are keys of an equi-join."""
    hits = v.chunks.where("label = 3").select("doc_id", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page")).distinct()
    return v.chunks.join(hits, ["doc_id", "page"], "left_semi").select("id", "doc_id", "page")


@query("""SELECT count(*) FILTER (length(coalesce(content_text, '')) < 50) AS short, count(*) FILTER (length(coalesce(content_text, '')) > 8000) AS long,
    count(*) FILTER (content_text IS NULL) AS none FROM chunks""")
def length_cohorts(v: Views) -> DataFrame:
    n = F.length(F.coalesce("content_text", F.lit("")))
    return v.chunks.agg(F.count_if(n < 50).alias("short"), F.count_if(n > 8000).alias("long"), F.count_if(F.col("content_text").isNull()).alias("none"))


@query("SELECT id FROM chunks WHERE chunk_type = 'image' AND coalesce(nullif(caption, ''), '') = ''")
def empty_caption(v: Views) -> DataFrame:
    return v.chunks.where("chunk_type = 'image' AND coalesce(nullif(caption, ''), '') = ''").select("id")


def candidates(chunks: DataFrame, docs: DataFrame, missing: bool = True, error: str | None = None, filename: str | None = None, chunk_type: str | None = None) -> DataFrame:
    """Chunks to embed again; a condition that is not given does not count."""
    out = chunks.join(docs.select("doc_id", "filename"), "doc_id")
    if missing:
        out = out.where("embedding IS NULL")
    if error is not None:
        out = out.where(meta("embedding_error") == error)
    if filename is not None:
        out = out.where(F.col("filename") == filename)
    if chunk_type is not None:
        out = out.where(F.col("chunk_type") == chunk_type)
    return out.select("filename", "page", "id", "chunk_type")


@query("SELECT filename, page, id, chunk_type FROM chunks JOIN docs USING (doc_id) WHERE embedding IS NULL AND json_extract_string(meta, '$.embedding_error') = 'embed_failed' AND chunk_type = 'text' ORDER BY filename, page, id LIMIT 20")
def backfill_candidates(v: Views) -> DataFrame:
    return candidates(v.chunks, v.docs, error="embed_failed", chunk_type="text").orderBy("filename", "page", "id").limit(20)


@query("SELECT doc_id FROM documents WHERE length(text) >= 50")
def min_len_filter(v: Views) -> DataFrame:
    return v.table("documents").where(F.length("text") >= 50).select("doc_id")


@query("SELECT id, page, chunk_type, left(content_text, 300) AS preview, left(caption, 200) AS caption_preview, embedding IS NOT NULL AS has_embedding FROM chunks WHERE doc_id = 7 ORDER BY page, id")
def doc_chunks_preview(v: Views) -> DataFrame:
    return v.chunks.where("doc_id = 7").select("id", "page", "chunk_type", F.left("content_text", F.lit(300)).alias("preview"), F.left("caption", F.lit(200)).alias("caption_preview"), F.col("embedding").isNotNull().alias("has_embedding")).orderBy("page", "id")


@query("SELECT filename, count(*) AS n, min(page) AS first_page, max(page) AS last_page FROM chunks JOIN docs USING (doc_id) GROUP BY filename")
def chunks_join_docs(v: Views) -> DataFrame:
    return v.chunks.join(v.docs, "doc_id").groupBy("filename").agg(F.count("*").alias("n"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query("""SELECT d.doc_id, d.filename, count(c.id) AS n_chunks, count(c.id) FILTER (c.chunk_type = 'image') AS n_images, max(json_extract_string(c.meta, '$.content_type')) AS content_type
    FROM docs d LEFT JOIN chunks c USING (doc_id) GROUP BY 1, 2 ORDER BY d.doc_id DESC LIMIT 50""")
def list_documents(v: Views) -> DataFrame:
    return (
        v.docs.join(v.chunks, "doc_id", "left")
        .groupBy("doc_id", "filename")
        .agg(F.count("id").alias("n_chunks"), F.count_if(F.col("chunk_type") == "image").alias("n_images"), F.max(meta("content_type")).alias("content_type"))
        .orderBy(F.desc("doc_id"))
        .limit(50)
    )


@query("""SELECT doc_id, filename FROM docs WHERE filename LIKE 'http%' AND doc_id IN (SELECT doc_id FROM chunks)
    AND doc_id NOT IN (SELECT doc_id FROM chunks WHERE chunk_type = 'image')""")
def docs_missing_images(v: Views) -> DataFrame:
    return v.docs.where(F.col("filename").startswith("http")).join(v.chunks, "doc_id", "left_semi").join(v.chunks.where("chunk_type = 'image'"), "doc_id", "left_anti").select("doc_id", "filename")


@query("""SELECT d.source, count(*) AS total, count(*) FILTER (s.doc_id IS NULL) AS new, count(s.doc_id) AS existing
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM chunks) s USING (doc_id) GROUP BY d.source""")
def dry_run_new_existing(v: Views) -> DataFrame:
    stored = v.chunks.select(F.col("doc_id").alias("stored")).distinct()
    return v.table("documents").join(stored, F.col("doc_id") == F.col("stored"), "left").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("stored").isNull()).alias("new"), F.count("stored").alias("existing"))


@query("""WITH stored AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha256 END AS old FROM docs WHERE doc_id % 4 <> 3)
    SELECT d.doc_id, old IS NULL AS is_new FROM docs d LEFT JOIN stored s USING (doc_id) WHERE old IS DISTINCT FROM sha256""")
def should_process(v: Views) -> DataFrame:
    """Documents that are new or whose content hash differs from the stored one."""
    stored = v.docs.where("doc_id % 4 <> 3").selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha256 END AS old")
    return v.docs.join(stored, "doc_id", "left").where(~F.col("old").eqNullSafe(F.col("sha256"))).select("doc_id", F.col("old").isNull().alias("is_new"))


@query("""SELECT regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), 'www\\.', '', 'g') AS domain, count(*) AS n, count(DISTINCT source) AS feeds
    FROM pages LEFT JOIN (SELECT DISTINCT source, 'ththre.example.' || CASE WHEN source < 'src3' THEN 'com' ELSE 'org' END AS d FROM documents) f
    ON regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), 'www\\.', '', 'g') = f.d GROUP BY 1""")
def url_domain_join(v: Views) -> DataFrame:
    """The authority keeps its port; every ``www.`` in it is dropped."""
    feeds = v.table("documents").select("source", F.concat(F.lit("ththre.example."), F.when(F.col("source") < "src3", "com").otherwise("org")).alias("d")).distinct()
    pages = v.table("pages").select("page_id", F.replace(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit("www."), F.lit("")).alias("domain"))
    per_feed = feeds.groupBy("d").agg(F.count_distinct("source").alias("feeds"))
    return pages.groupBy("domain").agg(F.count("*").alias("p")).join(per_feed, F.col("domain") == F.col("d"), "left").select("domain", (F.col("p") * F.greatest(F.coalesce("feeds", F.lit(1)), F.lit(1))).alias("n"), F.coalesce("feeds", F.lit(0)).alias("feeds"))


@query("""WITH last AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS state FROM events WHERE user_id % 3 <> 0 GROUP BY 1), nodes AS (SELECT DISTINCT user_id FROM events)
    SELECT n.user_id, coalesce(state, 'unknown') AS state, coalesce(h.errors, 0) AS errors FROM nodes n LEFT JOIN last USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1) h USING (user_id)""")
def status_left_join(v: Views) -> DataFrame:
    events = v.table("events")
    last = events.where("user_id % 3 <> 0").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    errors = events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"))
    return events.select("user_id").distinct().join(last, "user_id", "left").join(errors, "user_id", "left").select("user_id", F.coalesce("state", F.lit("unknown")).alias("state"), F.coalesce("errors", F.lit(0)).alias("errors"))


@query("""WITH urls AS (SELECT doc_id, unnest(generate_series(0, 2)) AS pos FROM docs), u AS (SELECT doc_id, pos, 'https://img.example.com/' || doc_id || '_' || pos || '.jpg' AS url FROM urls)
    SELECT c.id, u.url FROM chunks c JOIN u ON c.doc_id = u.doc_id AND c.id % 4 = u.pos WHERE c.chunk_type = 'image'""")
def positional_join(v: Views) -> DataFrame:
    """An image chunk's number picks from its document's list of URLs."""
    urls = v.docs.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda p: F.concat(F.lit("https://img.example.com/"), F.col("doc_id"), F.lit("_"), p, F.lit(".jpg")))).alias("pos", "url"))
    return v.chunks.where("chunk_type = 'image'").join(urls, ["doc_id"]).where(F.col("id") % 4 == F.col("pos")).select("id", "url")


@query("SELECT (SELECT count(*) FROM docs) AS docs, count(*) AS chunks, count(*) FILTER (chunk_type = 'image') AS images, count(*) FILTER (embedding IS NULL) AS unembedded FROM chunks")
def corpus_counts(v: Views) -> DataFrame:
    docs = v.docs.agg(F.count("*").alias("docs"))
    chunks = v.chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "image").alias("images"), F.count_if(F.col("embedding").isNull()).alias("unembedded"))
    return docs.crossJoin(chunks)  # one row each


@query("SELECT chunk_type, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, 1")
def chunks_by_type(v: Views) -> DataFrame:
    return v.chunks.groupBy("chunk_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chunk_type")


@query("SELECT coalesce(json_extract_string(meta, '$.feed_name'), 'unknown') AS source, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY 1")
def docs_by_source(v: Views) -> DataFrame:
    return v.chunks.groupBy(F.coalesce(meta("feed_name"), F.lit("unknown")).alias("source")).agg(F.count_distinct("doc_id").alias("docs"))


@query("""SELECT d.doc_id, d.filename, d.created_at, count(c.id) FILTER (c.chunk_type = 'text') AS texts, count(c.id) FILTER (c.chunk_type = 'image') AS images, max(json_extract_string(c.meta, '$.title')) AS title
    FROM docs d LEFT JOIN chunks c USING (doc_id) GROUP BY 1, 2, 3 ORDER BY d.created_at DESC LIMIT 10""")
def latest_docs(v: Views) -> DataFrame:
    # the newest documents are chosen first, so only their chunks are looked up
    newest = v.docs.select("doc_id", "filename", "created_at").orderBy(F.desc("created_at")).limit(10)
    return newest.join(v.chunks, "doc_id", "left").groupBy("doc_id", "filename", "created_at").agg(F.count_if(F.col("chunk_type") == "text").alias("texts"), F.count_if(F.col("chunk_type") == "image").alias("images"), F.max(meta("title")).alias("title"))


@query("""SELECT d.doc_id, CASE WHEN d.filename LIKE '%.pdf' THEN 'pdf' ELSE coalesce(max(json_extract_string(c.meta, '$.content_type')), max(json_extract_string(c.meta, '$.source')), 'unknown') END AS kind, count(c.id) AS n
    FROM docs d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id, d.filename""")
def ingestion_history(v: Views) -> DataFrame:
    return (
        v.docs.join(v.chunks, "doc_id", "left")
        .groupBy("doc_id", "filename")
        .agg(F.max(meta("content_type")).alias("a"), F.max(meta("source")).alias("b"), F.count("id").alias("n"))
        .select("doc_id", F.when(F.col("filename").endswith(".pdf"), "pdf").otherwise(F.coalesce("a", "b", F.lit("unknown"))).alias("kind"), "n")
    )


@query("SELECT count(DISTINCT asset_path) AS n FROM chunks")
def unique_assets(v: Views) -> DataFrame:
    return v.chunks.agg(F.count_distinct("asset_path").alias("n"))


@query("""SELECT count(*) AS chunks, count(DISTINCT doc_id) AS docs, count(*) FILTER (chunk_type = 'text') AS texts, count(*) FILTER (chunk_type = 'image') AS images,
    count(*) FILTER (embedding IS NULL) AS no_embedding, count(*) FILTER (embedding IS NULL AND chunk_type = 'text') AS no_text_embedding,
    count(*) FILTER (json_exists(meta, '$.embedding_error')) AS errors, count(*) FILTER (json_exists(meta, '$.heading_path')) AS headings,
    count(*) FILTER (chunk_type = 'image' AND coalesce(nullif(caption, ''), '') = '') AS no_caption, count(*) FILTER (chunk_type = 'image' AND coalesce(asset_path, '') = '') AS no_asset,
    count(*) FILTER (chunk_type = 'text' AND length(coalesce(content_text, '')) < 50) AS short_texts, count(*) FILTER (length(coalesce(content_text, '')) > 8000) AS long_texts,
    round(100.0 * count(*) FILTER (embedding IS NOT NULL) / count(*), 2) AS embedded_pct, round(100.0 * count(*) FILTER (json_exists(meta, '$.heading_path')) / count(*), 2) AS heading_pct FROM chunks""")
def integrity_report(v: Views) -> DataFrame:
    """All statistics of the store in one pass over the chunks."""
    text, image, bare = F.col("chunk_type") == "text", F.col("chunk_type") == "image", F.col("embedding").isNull()
    n, headed = F.count("*"), F.count_if(has_key("heading_path"))
    length = F.length(F.coalesce("content_text", F.lit("")))
    return v.chunks.agg(
        n.alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.count_if(text).alias("texts"), F.count_if(image).alias("images"),
        F.count_if(bare).alias("no_embedding"), F.count_if(bare & text).alias("no_text_embedding"), F.count_if(has_key("embedding_error")).alias("errors"), headed.alias("headings"),
        F.count_if(image & (F.coalesce("caption", F.lit("")) == "")).alias("no_caption"), F.count_if(image & (F.coalesce("asset_path", F.lit("")) == "")).alias("no_asset"),
        F.count_if(text & (length < 50)).alias("short_texts"), F.count_if(length > 8000).alias("long_texts"),
        share(F.count("embedding"), n).alias("embedded_pct"), share(headed, n).alias("heading_pct"),
    )


@query("SELECT doc_id % 3 = 0 AS rss, count(*) AS n, round(100.0 * count(embedding) / count(*), 2) AS pct FROM chunks GROUP BY 1")
def coverage_pct(v: Views) -> DataFrame:
    return v.chunks.groupBy((F.col("doc_id") % 3 == 0).alias("rss")).agg(F.count("*").alias("n"), share(F.count("embedding"), F.count("*")).alias("pct"))


@query("SELECT filename, count(*) AS n FROM chunks JOIN docs USING (doc_id) WHERE embedding IS NULL GROUP BY 1 ORDER BY n DESC, filename LIMIT 10")
def top_missing(v: Views) -> DataFrame:
    return _top_files(v, F.col("embedding").isNull())


def _top_files(v: Views, of: Column) -> DataFrame:
    """The ten files with most chunks that ``of`` holds for, counted by document before the join."""
    found = v.chunks.where(of).groupBy("doc_id").agg(F.count("*").alias("n"))
    return found.join(v.docs, "doc_id").groupBy("filename").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "filename").limit(10)


_TEXT_LENGTH = "length(coalesce(content_text, ''))"


@query(f"SELECT filename, count(*) AS n FROM chunks JOIN docs USING (doc_id) WHERE chunk_type = 'text' AND {_TEXT_LENGTH} < 50 GROUP BY 1 ORDER BY n DESC, filename LIMIT 10")
def top_short(v: Views) -> DataFrame:
    return _top_files(v, F.expr(f"chunk_type = 'text' AND {_TEXT_LENGTH} < 50"))


@query(f"SELECT filename, count(*) AS n FROM chunks JOIN docs USING (doc_id) WHERE chunk_type = 'text' AND {_TEXT_LENGTH} > 8000 GROUP BY 1 ORDER BY n DESC, filename LIMIT 10")
def top_long(v: Views) -> DataFrame:
    return _top_files(v, F.expr(f"chunk_type = 'text' AND {_TEXT_LENGTH} > 8000"))


@query("WITH gone AS (SELECT DISTINCT id FROM chunks WHERE label = 7) SELECT id, doc_id FROM chunks WHERE id NOT IN (SELECT id FROM gone)")
def delete_by_ids(v: Views) -> DataFrame:
    """Chunks without those on a list of ids, however long; an anti-join takes the place of batches."""
    listed = v.chunks.where("label = 7").select("id").distinct()
    return v.chunks.select("id", "doc_id").join(listed, "id", "left_anti")


@query("""WITH r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN user_id || '' WHEN 2 THEN '"' || user_id || '"' WHEN 3 THEN '"-' || user_id || '"' WHEN 4 THEN '-' || user_id WHEN 5 THEN user_id || '.5' ELSE '""' END AS raw FROM events)
    SELECT event_id, CASE WHEN regexp_full_match(raw, '-?[0-9]+') THEN raw::BIGINT WHEN regexp_full_match(raw, '"[0-9]+"') THEN trim(raw, '"')::BIGINT END AS n FROM r""")
def coerce_int(v: Views) -> DataFrame:
    """Whole numbers from JSON values: a number is one, a string of digits too; a boolean, a sign in a string or a fraction is none."""
    user = F.col("user_id").cast("string")
    kinds = (F.lit("true"), user, F.concat(F.lit('"'), user, F.lit('"')), F.concat(F.lit('"-'), user, F.lit('"')), F.concat(F.lit("-"), user), F.concat(user, F.lit(".5")), F.lit('""'))
    raw = F.element_at(F.array(*kinds), (1 + F.col("event_id") % 7).cast("int"))
    number = F.when(raw.rlike("^-?[0-9]+$"), raw.try_cast("bigint")).when(raw.rlike('^"[0-9]+"$'), F.btrim(raw, F.lit('"')).try_cast("bigint"))
    return v.table("events").select("event_id", number.alias("n"))


@query("""WITH g AS (SELECT filename, coalesce(json_extract_string(meta, '$.embedding_error'), 'none') AS error, count(*) AS n FROM chunks JOIN docs USING (doc_id) GROUP BY 1, 2)
    SELECT filename, string_agg(error || '=' || n, ',' ORDER BY error) AS errors FROM g GROUP BY 1""")
def nested_counts(v: Views) -> DataFrame:
    inner = v.chunks.join(v.docs.select("doc_id", "filename"), "doc_id").groupBy("filename", F.coalesce(meta("embedding_error"), F.lit("none")).alias("error")).agg(F.count("*").alias("n"))
    return inner.groupBy("filename").agg(F.array_join(F.array_sort(F.collect_list(F.concat("error", F.lit("="), "n"))), ",").alias("errors"))


@query("SELECT toxic, quality, count(*) AS n FROM labels GROUP BY ALL")
def label_counts(v: Views) -> DataFrame:
    return v.table("labels").groupBy("toxic", "quality").agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS articles, count(*) FILTER (length(text) >= 50) AS ingested, sum(n_chars // 1500 + 1)::BIGINT AS chunks FROM documents GROUP BY source
    UNION ALL SELECT 'all', count(*), count(*) FILTER (length(text) >= 50), sum(n_chars // 1500 + 1)::BIGINT FROM documents""")
def ingest_totals(v: Views) -> DataFrame:
    totals = v.table("documents").rollup("source").agg(F.grouping("source").alias("whole"), F.count("*").alias("articles"), F.count_if(F.length("text") >= 50).alias("ingested"), F.sum(F.expr("n_chars div 1500 + 1")).alias("chunks"))
    return totals.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("source")).alias("source"), "articles", "ingested", "chunks")


@query("SELECT source AS dir, count(*) AS files, sum(n_chars)::BIGINT AS bytes, round(100.0 * sum(n_chars) / (SELECT sum(n_chars) FROM documents), 2) AS pct FROM documents GROUP BY 1")
def dir_usage(v: Views) -> DataFrame:
    sizes = v.table("documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))
    total = sizes.agg(F.sum("bytes").alias("total"))  # one row
    return sizes.crossJoin(total).select(F.col("source").alias("dir"), "files", "bytes", share(F.col("bytes"), F.col("total")).alias("pct"))


@query("WITH g AS (SELECT sha256, count(*) AS n FROM docs GROUP BY 1) SELECT count(*) AS unique_hashes, count(*) FILTER (n > 1) AS dup_groups, coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM g")
def exact_dup_stats(v: Views) -> DataFrame:
    return v.docs.groupBy("sha256").agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_hashes"), F.count_if(F.col("n") > 1).alias("dup_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


@query("""WITH p AS (SELECT sha256, min(doc_id) AS keep FROM docs GROUP BY 1)
    SELECT doc_id, keep AS canonical_id, doc_id <> keep AS is_copy FROM docs JOIN p USING (sha256)""")
def exact_dedup(v: Views) -> DataFrame:
    """Each document's canonical copy: the smallest id of equal content hashes."""
    first = v.docs.groupBy("sha256").agg(F.min("doc_id").alias("canonical_id"))
    return v.docs.join(first, "sha256").select("doc_id", "canonical_id", (F.col("doc_id") != F.col("canonical_id")).alias("is_copy"))


@query(f"SELECT max(created_at) AS newest, ({EPOCH} + 864000 - max(created_at)) // 86400 AS age_days, ({EPOCH} + 864000 - max(created_at)) // 86400 > 7 AS warn FROM docs")
def freshness(v: Views, now: int = EPOCH + 864000) -> DataFrame:
    newest = v.docs.agg(F.max("created_at").alias("newest"))
    return newest.withColumn("age_days", F.expr(f"({now} - newest) div 86400")).withColumn("warn", F.col("age_days") > 7)


@query("""SELECT count(DISTINCT doc_id) FILTER (filename LIKE 'http%') AS rss_docs, count(DISTINCT doc_id) FILTER (filename NOT LIKE 'http%') AS pdf_docs,
    count(id) FILTER (filename LIKE 'http%') AS rss_chunks, count(id) FILTER (filename NOT LIKE 'http%') AS pdf_chunks FROM docs LEFT JOIN chunks USING (doc_id)""")
def rss_status(v: Views) -> DataFrame:
    rss = F.col("filename").startswith("http")
    per_doc = v.docs.join(v.chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    return per_doc.agg(F.count_if(rss).alias("rss_docs"), F.count_if(~rss).alias("pdf_docs"), F.coalesce(F.sum(F.when(rss, F.col("n"))), F.lit(0)).alias("rss_chunks"), F.coalesce(F.sum(F.when(~rss, F.col("n"))), F.lit(0)).alias("pdf_chunks"))


@query("""WITH r AS (SELECT asset_path, id, doc_id, row_number() OVER (PARTITION BY asset_path ORDER BY id DESC) AS n FROM chunks WHERE chunk_type = 'image' AND asset_path IS NOT NULL)
    SELECT asset_path, id, doc_id FROM r WHERE n = 1""")
def latest_image_per_asset(v: Views) -> DataFrame:
    """An aggregation, as it combines before the shuffle: the newest chunk of an asset is its largest (id, doc)."""
    newest = v.chunks.where("chunk_type = 'image' AND asset_path IS NOT NULL").groupBy("asset_path").agg(F.max(F.struct("id", "doc_id")).alias("m"))
    return newest.select("asset_path", "m.id", "m.doc_id")


@query("SELECT id, asset_path, (SELECT count(*) FROM chunks WHERE chunk_type = 'image') AS total FROM chunks WHERE chunk_type = 'image' ORDER BY id DESC LIMIT 10 OFFSET 5")
def paginate(v: Views) -> DataFrame:
    images = v.chunks.where("chunk_type = 'image'")
    page = images.select("id", "asset_path").orderBy(F.desc("id")).offset(5).limit(10)
    return page.crossJoin(images.agg(F.count("*").alias("total")))  # one row


@query("""WITH disk AS (SELECT 'assets/' || (vec_id % 97) || '.jpg' AS path FROM embeddings) SELECT DISTINCT path FROM disk WHERE path NOT IN (SELECT asset_path FROM chunks WHERE asset_path IS NOT NULL)""")
def orphan_assets(v: Views) -> DataFrame:
    disk = v.table("embeddings").select(F.concat(F.lit("assets/"), F.col("vec_id") % 97, F.lit(".jpg")).alias("path"))
    return disk.distinct().join(v.chunks.where("asset_path IS NOT NULL").select(F.col("asset_path").alias("path")), "path", "left_anti")


@query("""WITH have AS (SELECT user_id, list(DISTINCT event_type) AS got FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_filter(['signup', 'click', 'view', 'purchase', 'error'], lambda x: NOT list_contains(got, x))), ',') AS missing FROM have""")
def missing_expected(v: Views) -> DataFrame:
    expected = F.array(*map(F.lit, ("signup", "click", "view", "purchase", "error")))
    return v.table("events").groupBy("user_id").agg(F.collect_set("event_type").alias("got")).select("user_id", F.array_join(F.array_sort(F.array_except(expected, "got")), ",").alias("missing"))


@query("SELECT DISTINCT asset_path FROM chunks WHERE asset_path LIKE 'assets/%'")
def distinct_old_paths(v: Views) -> DataFrame:
    return v.chunks.where(F.col("asset_path").startswith("assets/")).select("asset_path").distinct()


@query("SELECT DISTINCT doc_id FROM chunks WHERE label = 1 INTERSECT SELECT DISTINCT doc_id FROM chunks WHERE label = 2")
def set_intersect(v: Views) -> DataFrame:
    return v.chunks.where("label = 1").select("doc_id").intersect(v.chunks.where("label = 2").select("doc_id"))


@query("""WITH old AS (SELECT doc_id, filename, sha256, created_at FROM docs WHERE doc_id % 4 <> 0),
    new AS (SELECT doc_id, filename || '?v=2' AS filename, sha256 FROM docs WHERE doc_id % 3 = 0)
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.filename, o.filename) AS filename, coalesce(n.sha256, o.sha256) AS sha256, coalesce(o.created_at, 1800000000) AS created_at, CASE WHEN n.doc_id IS NULL THEN o.created_at ELSE 1800000000 END AS updated_at
    FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
def upsert_docs(v: Views, now: int = 1_800_000_000) -> DataFrame:
    """New rows replace the fields of old ones of the same id, which keep the time of their making."""
    old = v.docs.where("doc_id % 4 <> 0").select("doc_id", "filename", "sha256", "created_at")
    new = v.docs.where("doc_id % 3 = 0").select("doc_id", F.concat("filename", F.lit("?v=2")).alias("new_name"), F.col("sha256").alias("new_sha"), F.lit(True).alias("is_new"))
    return old.join(new, "doc_id", "full").select(
        "doc_id", F.coalesce("new_name", "filename").alias("filename"), F.coalesce("new_sha", "sha256").alias("sha256"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"), F.when(F.col("is_new"), now).otherwise(F.col("created_at")).alias("updated_at"),
    )


@query("""WITH again AS (SELECT doc_id FROM docs WHERE doc_id % 10 = 0), fresh AS (SELECT 1000000000 + doc_id AS id, doc_id, 'text' AS chunk_type FROM again)
    SELECT id, doc_id, chunk_type FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM again) UNION ALL SELECT id, doc_id, chunk_type FROM fresh""")
def replace_doc_chunks(v: Views) -> DataFrame:
    """Chunks of documents read again go, with all they had; the new ones come with new ids."""
    again = v.docs.where("doc_id % 10 = 0").select("doc_id")
    fresh = again.select((F.lit(1_000_000_000) + F.col("doc_id")).alias("id"), "doc_id", F.lit("text").alias("chunk_type"))
    return v.chunks.select("id", "doc_id", "chunk_type").join(again, "doc_id", "left_anti").select("id", "doc_id", "chunk_type").unionByName(fresh)


@query("""WITH u AS (SELECT vec_id AS id, embedding AS new FROM embeddings WHERE vec_id % 34 = 0)
    SELECT c.id, c.embedding IS NULL AND u.new IS NOT NULL AS filled, coalesce(c.embedding, u.new) IS NOT NULL AS embedded,
    json_exists(c.meta, '$.embedding_error') AND NOT (c.embedding IS NULL AND u.new IS NOT NULL) AS has_error FROM chunks c LEFT JOIN u USING (id)""")
def backfill_embeddings(v: Views) -> DataFrame:
    """Only chunks without a vector take one, and then lose their error."""
    new = v.table("embeddings").where("vec_id % 34 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("new"))
    filled = F.col("embedding").isNull() & F.col("new").isNotNull()
    return v.chunks.join(new, "id", "left").select("id", filled.alias("filled"), F.coalesce("embedding", "new").isNotNull().alias("embedded"), (has_key("embedding_error") & ~filled).alias("has_error"))


@query("""WITH m AS (SELECT DISTINCT asset_path AS old, 'shared/' || asset_path AS new FROM chunks WHERE asset_path LIKE '%2.jpg') SELECT id, coalesce(new, asset_path) AS asset_path FROM chunks LEFT JOIN m ON asset_path = old""")
def remap_assets(v: Views) -> DataFrame:
    moved = v.chunks.where(F.col("asset_path").endswith("2.jpg")).select(F.col("asset_path").alias("old")).distinct().withColumn("new", F.concat(F.lit("shared/"), "old"))
    return v.chunks.join(moved, F.col("asset_path") == F.col("old"), "left").select("id", F.coalesce("new", "asset_path").alias("asset_path"))


@query("SELECT doc_id, filename FROM docs WHERE filename NOT LIKE 'http%'")
def reset_rss_only(v: Views) -> DataFrame:
    return v.docs.where(~F.col("filename").startswith("http")).select("doc_id", "filename")


@query("""WITH e AS (SELECT c.id, c.meta, list_sort(['embed_failed', 'timeout'][:1 + (c.id % 2)::INT]) AS history FROM chunks c WHERE embedding IS NULL)
    SELECT id, array_to_string(list_append(history, 'retry_failed'), '|') AS history, len(history) + 1 AS n FROM e""")
def error_history(v: Views) -> DataFrame:
    """The last error is appended to those before it."""
    past = F.slice(F.array(F.lit("embed_failed"), F.lit("timeout")), F.lit(1), (1 + F.col("id") % 2).cast("int"))
    return v.chunks.where("embedding IS NULL").select("id", F.array_append(past, F.lit("retry_failed")).alias("h")).select("id", F.array_join("h", "|").alias("history"), F.size("h").cast("long").alias("n"))


@query("""WITH r AS (SELECT doc_id, id, page, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS n, length(coalesce(caption, content_text)) AS w FROM chunks)
    SELECT doc_id, id FROM r WHERE n <= 2 AND w > 200""")
def cap_per_page(v: Views, cap: int = 2) -> DataFrame:
    """The cap counts before the size test, so what fails the test still takes a place."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("id"))
    ranked = v.chunks.withColumn("n", n).where(F.col("n") <= cap)
    return ranked.where(F.length(F.coalesce("caption", "content_text")) > 200).select("doc_id", "id")


@query("""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS n FROM embeddings) SELECT label, vec_id FROM r WHERE n = 1""")
def argmax_per_group(v: Views) -> DataFrame:
    """The largest of each group, the first on a tie."""
    best = v.table("embeddings").groupBy("label").agg(F.max_by("vec_id", F.struct(F.col("embedding")[0], -F.col("vec_id"))).alias("vec_id"))
    return best.select("label", "vec_id")


@query("""WITH b AS (SELECT doc_id, min(CASE WHEN embedding[1] <> 0 THEN embedding[1] END)::DOUBLE AS l, max(embedding[2])::DOUBLE AS r FROM chunks WHERE embedding IS NOT NULL GROUP BY 1)
    SELECT doc_id, round(coalesce(l, 0.0), 6) AS l, round(coalesce(r, 0.0), 6) AS r FROM b""")
def bbox_union(v: Views) -> DataFrame:
    """Smallest and largest edges; an edge of zero counts as none, and none gives zero."""
    edges = v.chunks.where("embedding IS NOT NULL").groupBy("doc_id").agg(F.min(F.expr("CASE WHEN embedding[0] <> 0 THEN embedding[0] END")).cast("double").alias("l"), F.max(F.expr("embedding[1]")).cast("double").alias("r"))
    return edges.select("doc_id", F.round(F.coalesce("l", F.lit(0.0)), 6).alias("l"), F.round(F.coalesce("r", F.lit(0.0)), 6).alias("r"))


@query("""SELECT doc_id, source || ' › ' || lang || ' › p' || (n_chars // 1500) AS index_prefix, sha256(source || ' › ' || lang || ' › p' || (n_chars // 1500) || chr(10) || chr(10) || text) AS indexed_sha FROM documents""")
def index_prefix(v: Views) -> DataFrame:
    prefix = F.concat_ws(" › ", "source", "lang", F.concat(F.lit("p"), F.expr("n_chars div 1500")))
    return v.table("documents").select("doc_id", prefix.alias("index_prefix"), F.sha2(F.concat(prefix, F.lit("\n\n"), "text"), 256).alias("indexed_sha"))
