"""The operators of this subpackage as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.byte_bpe import bpe_digests
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.frames import held_out, table
from tessella.llm.lexical import lexical_search
from tessella.llm.packing import pack_documents
from tessella.llm.quality import score_quality
from tessella.llm.resampling import resample
from tessella.llm.simhash import simhash_components
from tessella.llm.suffix_dedup import remove_repeats
from tessella.llm.toolcalls import link_tool_calls
from tessella.llm.topk import exact_top_k
from tessella.llm.toxicity import score_toxicity
from tessella.llm.url_trie import Rule, filter_urls
from tessella.llm.warc import archived

#: The rules of the URL query (fixed values).
URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: What the tool-call query's tools take (fixed values).
TOOL_SCHEMAS = {
    "search": {
        "type": "object",
        "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 400}, "limit": {"type": "integer", "minimum": 1, "maximum": 6}},
        "required": ["query", "limit"],
        "additionalProperties": False,
    },
    "translate": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query", "target"]},
}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out("doc_id", 4, 2)
    return score_toxicity(docs, table(spark, sf_dir, "labels"), ~out).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out("doc_id", 3, 1)
    return score_quality(docs, table(spark, sf_dir, "labels"), ~out).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool traffic: a user's turn is asked of a tool, the turn after it answers, each builds on the last.

    A user's turn makes a call (``search`` or, for every third turn, ``translate``) with its whole text and its number;
    the turn that follows it, whoever's it is but a user's, is the result. A call builds on the one two turns before.
    """
    ident = F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn")
    before = F.concat(F.lit("c"), "conv_id", F.lit("_"), F.col("turn") - 2)
    asked = F.concat(F.lit("c"), "conv_id", F.lit("_"), F.col("turn") - 1)
    name = F.when(F.col("turn") % 3 == 2, "translate").otherwise("search")
    arguments = F.to_json(F.struct(F.col("text").alias("query"), (F.col("turn") + 1).alias("limit")))
    call = F.to_json(F.struct(F.array(F.struct(ident.alias("id"), name.alias("name"), arguments.alias("arguments"), before.alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(asked.alias("tool_call_id"), F.col("text").alias("content")))
    user = F.col("role") == "user"
    return conversations.select("conv_id", "turn", F.when(user, "assistant").otherwise("tool").alias("role"), F.when(user, call).otherwise(result).alias("text"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_tool_calls(tool_messages(table(spark, sf_dir, "conversations")), TOOL_SCHEMAS)
    return linked.withColumn("json_sha256", F.sha2("json", 256)).drop("json")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_byte_bpe,
        op3_top_k,
        op4_exact_dedup,
        op5_quality,
        op6_suffix_dedup,
        op7_simhash,
        op8_tool_calls,
        op9_url_filter,
        op10_packing,
        op11_resampling,
        op12_lexical,
        op13_warc,
    )
}

ORACLE_SQL = {
    "op3_top_k": """
        WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        pieces AS (SELECT doc_id, start, substr(h, 2 * start + 1, 1198) AS piece FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100, 500)) AS start FROM d)),
        m AS (SELECT doc_id, start, unnest(list_transform(range(least(500, length(piece) // 2 - 99)), lambda i: {'i': i, 'k': md5(substr(piece, 2 * i::INT + 1, 200))})) AS m FROM pieces),
        w AS (SELECT doc_id, start + m.i AS i, row_number() OVER (PARTITION BY m.k ORDER BY doc_id, start + m.i) > 1 AS again FROM m),
        g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM w WHERE again),
        n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY doc_id, run),
        p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
        k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op8_tool_calls": """
        WITH c AS (SELECT conv_id, turn, 'c' || conv_id || '_' || turn AS id, CASE WHEN turn % 3 = 2 THEN 'translate' ELSE 'search' END AS name, min(text) AS text, count(*) AS copies
                   FROM conversations WHERE role = 'user' GROUP BY conv_id, turn),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS n FROM c),
        l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, turn - 2 * n ORDER BY turn) - 1 AS level FROM o),
        r AS (SELECT conv_id, turn, 'c' || conv_id || '_' || (turn - 1) AS id, min(text) AS content, count(*) AS copies FROM conversations WHERE role <> 'user' GROUP BY conv_id, turn),
        b AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.id, r.id) AS call_id, l.name, l.level, l.turn AS call_turn, r.turn AS result_turn, l.text, r.content, coalesce(l.copies, r.copies) AS copies,
                     CASE WHEN l.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status FROM l FULL JOIN r ON l.conv_id = r.conv_id AND l.id = r.id),
        e AS (SELECT *, CASE WHEN name IS NULL THEN 'no call' WHEN name = 'translate' THEN '$.target: missing' ELSE
                     concat_ws('; ', CASE WHEN call_turn + 1 > 6 THEN '$.limit: above maximum' END, CASE WHEN length(text) > 400 THEN '$.query: too long' WHEN length(text) < 1 THEN '$.query: too short' END) END AS errors FROM b)
        SELECT conv_id, call_id, name, level, call_turn, result_turn, status, copies, errors = '' AS valid, errors,
               sha256('{"arguments":' || CASE WHEN name IS NULL THEN 'null' ELSE '{"limit":' || (call_turn + 1) || ',"query":' || to_json(text)::VARCHAR || '}' END || ',"id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null')
                      || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}') AS json_sha256 FROM e""",
    "op9_url_filter": r"""
        WITH u AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
            ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        fits AS (
            SELECT page_id, host, path, rule_host || rule_path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
            FROM u LEFT JOIN r ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1""",
    "op11_resampling": r"""
        WITH words AS (SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                       FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark)),
        runs AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)::INT), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w)::INT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
        counted AS (SELECT r, f, count(*) AS n FROM runs GROUP BY r, f),
        crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
        bytes AS (SELECT f, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INT + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT f FROM counted)),
        buckets AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, crc),
        sides AS (SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (r < 0), 0)::BIGINT AS t FROM counted JOIN buckets USING (f) GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM sides),
        weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM counted JOIN buckets USING (f) JOIN gains USING (bucket) WHERE r > 0 GROUP BY r),
        scored AS (SELECT r, doc_id, len(w) AS words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
                   FROM words LEFT JOIN weights USING (r) WHERE r > 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (words >= 20) OVER () AS able FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM placed""",
    "op12_lexical": r"""
        WITH words AS (SELECT r, doc_id, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                       FROM (SELECT row_number() OVER () AS r, doc_id, NULL AS item_id, text FROM documents
                             UNION ALL SELECT -row_number() OVER (), NULL, item_id, text FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark))),
        counted AS (SELECT r, doc_id, item_id, term, count(*) AS tf FROM words GROUP BY r, doc_id, item_id, term),
        sizes AS (SELECT r, sum(tf)::BIGINT AS size FROM counted WHERE r > 0 GROUP BY r),
        totals AS (SELECT count(*) AS docs, sum(size)::BIGINT AS terms FROM sizes),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM counted WHERE r > 0 GROUP BY term), totals),
        scored AS (SELECT q.r AS item, q.item_id, d.r, d.doc_id, sum(q.tf * weight * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * size * docs) // terms))))::BIGINT AS score
                   FROM counted q JOIN counted d ON q.term = d.term AND q.r < 0 AND d.r > 0 JOIN weights w ON w.term = q.term JOIN sizes s ON s.r = d.r, totals GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op13_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS n,
                          max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last, sha1(coalesce(html, '')) AS h FROM pages)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 10 * (i // 8)::INT + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN last END AS refers_to
        FROM p""",
}
