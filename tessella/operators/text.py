"""Scalar text functions as native expressions: hygiene, names, URLs, chats."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.registry import query
from tessella.sources.views import Views

#: Words that point back to what was said, and words that ask for images (fixed values).
DEICTIC = ("dabei", "dazu", "davon", "hierzu", "hierbei", "hierauf", "hierin", "darüber", "darin", "darunter", "daneben", "deren", "dessen", "diesem", "diesen", "dieser")
IMAGE_WORDS = ("bild", "bilder", "zeige", "foto", "abbildung", "grafik", "diagramm", "image", "show")
#: What marks an image URL as junk, and query parameters that only set a size (fixed values).
JUNK = (".svg", "vgwort.de", "/pixel", "/tracking", "/beacon")
SIZE_PARAMS = ("w", "h", "width", "height", "resize", "size", "q")
SIZE_MARKS, WIDTH_MARK = re.compile(r"_w\d+|_r[\d.]+|_fpx[\d.]+|_fpy[\d.]+"), re.compile(r"_w(\d+)")
#: Element types of layouts and their common names; ``_skip`` falls away (fixed values).
ELEMENT_TYPES = {
    "image": "image",
    "picture": "image",
    "png": "image",
    "jpeg": "image",
    "jpg": "image",
    "table": "table",
    "heading": "heading",
    "title": "heading",
    "h": "heading",
    "h1": "heading",
    "h2": "heading",
    "h3": "heading",
    "h4": "heading",
    "h5": "heading",
    "h6": "heading",
    "paragraph": "text",
    "text": "text",
    "p": "text",
    "textbox": "text",
    "list": "list",
    "ul": "list",
    "ol": "list",
    "list item": "text",
    "li": "text",
    "header": "_skip",
    "footer": "_skip",
    "table row": "_skip",
    "table cell": "_skip",
    "caption": "_skip",
}
#: Parts of a name that mark a secret (fixed values).
SECRETS = ("PASSWORD", "SECRET", "KEY", "ENCRYPTION")


def words(any_of: tuple[str, ...]) -> str:
    """A pattern for any of the words, whatever their case, not within another word."""
    return rf"(?iu)(^|[^\p{{L}}\p{{N}}_])({'|'.join(any_of)})($|[^\p{{L}}\p{{N}}_])"


def quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def embedding_input(text: Column, long: int = 40, least: float = 0.20) -> Column:
    """Text fit to be embedded: replacement characters and white space become one space; null if little of it is letters."""
    space = r"(?U)\s+"
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, "\ufffd+", " "), space, " "))
    alnum = F.length(F.regexp_replace(clean, r"[^\p{L}\p{N}]", ""))
    return F.when((clean != "") & ~((F.length(clean) > long) & (alnum / F.length(clean) < least)), clean)


def sanitize_name(name: Column) -> Column:
    """The last part of a path; what is no word character, dot or dash becomes ``_``; a default where nothing is left."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?U)[^\w.\-]", "_")
    return F.when(base == "", "upload.pdf").otherwise(base)


def preview(text: Column, n: int = 260) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(n))


def bare_image_url(url: str) -> str:
    """A URL without what only sets an image's size: path marks like ``_w520``, size parameters, the fragment.

    Parameters without a value go too; others are decoded and written anew, so that spellings of one URL are equal.
    """
    try:
        at = urlparse(url)
        held = [(name, value) for name, values in parse_qs(at.query).items() if name not in SIZE_PARAMS for value in values]
    except ValueError:  # no URL
        return url
    return urlunparse((at.scheme, at.netloc, SIZE_MARKS.sub("", at.path), "", urlencode(held), ""))


def normal_image_url(url: Column) -> Column:
    """``bare_image_url`` of a column; null of null."""

    @F.pandas_udf("string")
    def bare(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else bare_image_url(u))

    return bare(url)


def cdn_width(url: Column) -> Column:
    """The width in a URL's path mark; 0 without one."""
    return F.coalesce(F.regexp_extract(url, r"_w(\d+)", 1).try_cast("int"), F.lit(0))


def image_urls(v: Views) -> DataFrame:
    """Image URLs as pages of the given table would hold them: sizes in the path or the query, trackers among them."""
    kinds = F.array(F.lit("_w520.jpg"), F.lit("_w960_r1.5.jpg"), F.lit(".png?w=100&id=1"), F.lit("/tracking.gif"), F.lit(".SVG"))
    base = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/img"), F.col("page_id") % 3)
    return v.table("pages").select("page_id", F.posexplode(kinds).alias("pos", "tail"), base.alias("base")).select("page_id", "pos", F.concat("base", "tail").alias("image_url"))


IMG = "img AS (SELECT page_id, pos::INT AS pos, regexp_replace(url, '[?#].*$', '') || '/img' || (page_id % 3) || ['_w520.jpg', '_w960_r1.5.jpg', '.png?w=100&id=1', '/tracking.gif', '.SVG'][pos + 1] AS image_url FROM pages, range(5) t(pos))"
NORM = IMG + ", norm AS (SELECT *, regexp_replace(split_part(image_url, '?', 1), '_w\\d+|_r[\\d.]+|_fpx[\\d.]+|_fpy[\\d.]+', '', 'g') || CASE WHEN image_url LIKE '%id=1' THEN '?id=1' ELSE '' END AS base, coalesce(try_cast(regexp_extract(image_url, '_w(\\d+)', 1) AS INT), 0) AS width FROM img)"


@query(f"WITH {IMG} SELECT page_id, pos, regexp_matches(lower(image_url), '\\.svg|vgwort\\.de|/pixel|/tracking|/beacon') AS junk FROM img")
def junk_url(v: Views) -> DataFrame:
    return image_urls(v).select("page_id", "pos", F.lower("image_url").rlike("|".join(map(quoted, JUNK))).alias("junk"))


@query(f"WITH {NORM} SELECT page_id, pos, base FROM norm")
def normalize_url(v: Views) -> DataFrame:
    return image_urls(v).select("page_id", "pos", normal_image_url(F.col("image_url")).alias("base"))


@query(f"WITH {NORM} SELECT page_id, pos, width FROM norm", name="cdn_width")
def cdn_width_of(v: Views) -> DataFrame:
    return image_urls(v).select("page_id", "pos", cdn_width(F.col("image_url")).alias("width"))


@query(f"WITH {IMG} SELECT page_id, pos, coalesce(nullif(regexp_extract(regexp_replace(image_url, '[?#].*$', ''), '\\.([^./]+)$', 1)[:4], ''), 'jpg') AS ext FROM img")
def url_ext(v: Views) -> DataFrame:
    """The begin of a path's suffix, at most four characters; ``jpg`` without one."""
    suffix = F.left(F.regexp_extract(F.regexp_replace("image_url", "[?#].*$", ""), r"\.([^./]+)$", 1), F.lit(4))
    return image_urls(v).select("page_id", "pos", F.when(suffix == "", "jpg").otherwise(suffix).alias("ext"))


@query(f"WITH {NORM} SELECT page_id, base, image_url FROM norm QUALIFY row_number() OVER (PARTITION BY page_id, base ORDER BY width DESC, pos) = 1")
def url_variant_dedup(v: Views) -> DataFrame:
    """Of the sizes of one image on a page the widest stays, the first of equals."""
    url = F.col("image_url")
    best = F.max_by("image_url", F.struct(cdn_width(url), -F.col("pos")))
    return image_urls(v).groupBy("page_id", normal_image_url(url).alias("base")).agg(best.alias("image_url"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN '\ufffd\ufffd' || text WHEN doc_id % 11 = 0 THEN repeat('\ufffd', 60) WHEN doc_id % 13 = 0 THEN repeat('#', 50) || left(text, 5) ELSE text END, '\ufffd+', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM documents)
    SELECT doc_id, CASE WHEN c <> '' AND NOT (length(c) > 40 AND length(regexp_replace(c, '[^\\p{L}\\p{N}]', '', 'g')) / length(c) < 0.2) THEN sha256(c) END AS clean_sha FROM t""", name="embedding_input")
def embedding_input_of(v: Views) -> DataFrame:
    bad = "\ufffd"
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(bad * 2), "text")).when(F.col("doc_id") % 11 == 0, F.repeat(F.lit(bad), 60)).when(F.col("doc_id") % 13 == 0, F.concat(F.repeat(F.lit("#"), 50), F.left("text", F.lit(5)))).otherwise(F.col("text"))
    return v.table("documents").select("doc_id", F.sha2(embedding_input(text), 256).alias("clean_sha"))


@query("SELECT doc_id, regexp_replace(split_part('in/' || source || ' (' || lang || ') ' || left(text, 12) || '.pdf', '/', -1), '[^\\p{L}\\p{N}_.\\-]', '_', 'g') AS name FROM documents")
def sanitize_filename(v: Views) -> DataFrame:
    path = F.concat(F.lit("in/"), "source", F.lit(" ("), "lang", F.lit(") "), F.left("text", F.lit(12)), F.lit(".pdf"))
    return v.table("documents").select("doc_id", sanitize_name(path).alias("name"))


@query("SELECT doc_id, sha256(text) AS sha, left(sha256(text), 16) AS short FROM documents")
def sha256_text(v: Views) -> DataFrame:
    sha = F.sha2("text", 256)
    return v.table("documents").select("doc_id", sha.alias("sha"), F.left(sha, F.lit(16)).alias("short"))


@query("SELECT doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 260) AS preview FROM documents")
def clean_preview(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", preview(F.col("text")).alias("preview"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, t, unnest(generate_series(0, greatest(length(t) - 50 - 1, 0), 450)) AS start FROM c WHERE t <> '')
    SELECT doc_id, (start // 450)::INT AS n, sha256(substr(t, start + 1, 500)) AS sha, length(substr(t, start + 1, 500)) AS chars FROM s""")
def fixed_chunks(v: Views, size: int = 500, overlap: int = 50) -> DataFrame:
    """Pieces of fixed width, each beginning ``overlap`` characters before the last one's end; the end of the text ends them."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("t") - overlap - 1, F.lit(0)), F.lit(step))
    rows = v.table("documents").select("doc_id", text.alias("t")).where("t <> ''").select("doc_id", "t", F.posexplode(starts).alias("n", "start"))
    piece = F.substring("t", F.col("start") + 1, F.lit(size))
    return rows.select("doc_id", "n", F.sha2(piece, 256).alias("sha"), F.length(piece).alias("chars"))


@query("SELECT event_id, CASE WHEN regexp_matches(upper(event_type), 'PASSWORD|SECRET|KEY|ENCRYPTION|SIGN') THEN '****' ELSE props END AS shown FROM events")
def mask_secrets(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.when(F.upper("event_type").rlike("|".join((*SECRETS, "SIGN"))), "****").otherwise(F.col("props")).alias("shown"))


def asked_with_filter() -> Column:
    """Turns with filters before some of them."""
    return F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("@rss "), "text")).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("@A&B "), "text")).when(F.col("conv_id") % 4 == 2, F.concat(F.lit("@ "), "text")).otherwise(F.col("text"))


ASKED = "asked AS (SELECT conv_id, turn, role, CASE conv_id % 4 WHEN 0 THEN '@rss ' || text WHEN 1 THEN '@A&B ' || text WHEN 2 THEN '@ ' || text ELSE text END AS q FROM conversations)"


@query(f"""WITH {ASKED}, t AS (SELECT conv_id, turn, q, regexp_extract(q, '^@([^ ]*) ', 1) AS token, regexp_matches(q, '^@[^ ]* ') AS has FROM asked WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN has AND lower(token) IN ('rss', 'pdf') THEN lower(token) END AS source_type, CASE WHEN has AND lower(token) NOT IN ('rss', 'pdf') THEN regexp_replace(token, '[^\\p{{L}}\\p{{N}}_.\\-]', '_', 'g') END AS doc_filter,
    sha256(CASE WHEN has THEN trim(q[length(token) + 3:]) ELSE q END) AS query_sha FROM t""")
def parse_at_filter(v: Views) -> DataFrame:
    """``@rss`` and ``@pdf`` choose a source, another ``@name`` a document; an empty name means no filter at all."""
    q = F.col("q")
    token, has = F.regexp_extract(q, "^@([^ ]*) ", 1), q.rlike("^@[^ ]* ")
    kind = F.lower(token).isin("rss", "pdf")
    rest = F.when(has, F.trim(F.substring(q, F.length(token) + 3, F.length(q)))).otherwise(q)
    turns = v.table("conversations").where("role = 'user'").select("conv_id", "turn", asked_with_filter().alias("q"))
    return turns.select("conv_id", "turn", F.when(has & kind, F.lower(token)).alias("source_type"), F.when(has & ~kind, F.regexp_replace(token, r"(?U)[^\w.\-]", "_")).alias("doc_filter"), F.sha2(rest, 256).alias("query_sha"))


@query("""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN prev IS NOT NULL AND trim(left(prev, 120)) <> '' AND (length(text) < 50 OR regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(dabei|dazu|davon|hierzu|hierbei|hierauf|hierin|darüber|darin|darunter|daneben|deren|dessen|diesem|diesen|dieser)($|[^\\p{L}\\p{N}_])'))
    THEN 'Bezugnehmend auf: ' || trim(left(prev, 120)) || ' — ' || text ELSE text END AS rewritten FROM u""")
def followup_rewrite(v: Views) -> DataFrame:
    """A short question, or one that points back, is put after the one before it."""
    prev = F.trim(F.left(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(120)))
    turns = v.table("conversations").where("role = 'user'").select("conv_id", "turn", "text", prev.alias("prev"))
    needs = F.col("prev").isNotNull() & (F.col("prev") != "") & ((F.length("text") < 50) | F.col("text").rlike(words(DEICTIC)))
    return turns.select("conv_id", "turn", F.when(needs, F.concat(F.lit("Bezugnehmend auf: "), "prev", F.lit(" — "), "text")).otherwise(F.col("text")).alias("rewritten"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), u AS (SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS q, max_by(text, turn) FILTER (role = 'assistant') AS a FROM m GROUP BY 1)
    SELECT conv_id, CASE WHEN length(q) < 100 AND a IS NOT NULL THEN q || ' ' || trim(left(regexp_replace(a, '^[^\\n.]*[\\n.]', ''), 150)) ELSE q END AS hinted FROM u WHERE q IS NOT NULL""")
def followup_hint(v: Views) -> DataFrame:
    """A short question takes the begin of the last answer along, without the answer's first sentence."""
    last = lambda role: F.max_by("text", F.when(F.col("role") == role, F.col("turn")))
    rows = v.table("conversations").groupBy("conv_id").agg(last("user").alias("q"), last("assistant").alias("a"), F.count_if(F.col("role") == "user").alias("n")).where("n > 0")
    hint = F.trim(F.left(F.regexp_replace("a", r"^[^\n.]*[\n.]", ""), F.lit(150)))
    return rows.select("conv_id", F.when((F.length("q") < 100) & F.col("a").isNotNull(), F.concat("q", F.lit(" "), hint)).otherwise(F.col("q")).alias("hinted"))


@query("SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'user'), max_by(text, turn)) AS text FROM conversations GROUP BY 1")
def last_user_text(v: Views) -> DataFrame:
    return v.table("conversations").groupBy("conv_id").agg(F.coalesce(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))), F.max_by("text", "turn")).alias("text"))


@query("""SELECT conv_id, turn, regexp_matches(CASE WHEN turn % 3 = 0 THEN 'Zeige ' || text WHEN turn % 3 = 1 THEN 'Zeigen ' || text ELSE text || ' BILD' END, '(?i)(^|[^\\p{L}\\p{N}_])(bild|bilder|zeige|foto|abbildung|grafik|diagramm|image|show)($|[^\\p{L}\\p{N}_])') AS wants FROM conversations""")
def image_intent(v: Views) -> DataFrame:
    asked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Zeige "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Zeigen "), "text")).otherwise(F.concat("text", F.lit(" BILD")))
    return v.table("conversations").select("conv_id", "turn", asked.rlike(words(IMAGE_WORDS)).alias("wants"))


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'user' END AS role, left(trim(text), 8000) AS content FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM m WHERE content <> '') SELECT conv_id, turn, role, content FROM r WHERE back <= 12""")
def sanitize_messages(v: Views, keep: int = 12) -> DataFrame:
    """The last messages of a chat, cut to size; unknown roles count as the user's."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    role = F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise("user")
    rows = v.table("conversations").select("conv_id", "turn", role.alias("role"), F.left(F.trim("text"), F.lit(8000)).alias("content")).where("content <> ''")
    return rows.withColumn("back", back).where(F.col("back") <= keep).drop("back")


def element_type(raw: Column) -> Column:
    """The common name of a layout's element type; unknown ones are text."""
    known = F.create_map(*[F.lit(x) for pair in ELEMENT_TYPES.items() for x in pair])
    return F.coalesce(known[F.lower(raw)], F.lit("text"))


@query("""WITH t AS (SELECT event_id, ['Heading', 'h2', 'PICTURE', 'ul', 'footer', 'li', 'blink', 'table'][1 + event_id % 8] AS raw FROM events)
    SELECT event_id, CASE lower(raw) WHEN 'heading' THEN 'heading' WHEN 'h2' THEN 'heading' WHEN 'picture' THEN 'image' WHEN 'ul' THEN 'list' WHEN 'footer' THEN '_skip' WHEN 'table' THEN 'table' ELSE 'text' END AS kind FROM t""")
def normalize_type(v: Views) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("Heading", "h2", "PICTURE", "ul", "footer", "li", "blink", "table"))), (1 + F.col("event_id") % 8).cast("int"))
    return v.table("events").select("event_id", element_type(raw).alias("kind"))


@query("SELECT id, CASE WHEN chunk_type <> 'image' THEN coalesce(content_text, '') WHEN coalesce(json_extract_string(meta, '$.title'), '') <> '' THEN '[' || json_extract_string(meta, '$.feed_name') || '] ' || json_extract_string(meta, '$.title') || ' — ' || coalesce(nullif(caption, ''), 'Bild') ELSE coalesce(nullif(caption, ''), 'Bild') END AS embed_text FROM chunks")
def embed_text(v: Views) -> DataFrame:
    """What is embedded for a chunk: its text, or an image's caption after its feed and title."""
    title, feed = F.get_json_object("meta", "$.title"), F.get_json_object("meta", "$.feed_name")
    caption = F.when(F.coalesce("caption", F.lit("")) == "", "Bild").otherwise(F.col("caption"))
    text = (
        F.when(F.col("chunk_type") != "image", F.coalesce("content_text", F.lit("")))
        .when((title != "") & (feed != ""), F.concat(F.lit("["), feed, F.lit("] "), title, F.lit(" — "), caption))
        .when(title != "", F.concat(title, F.lit(" — "), caption))
        .otherwise(caption)
    )
    return v.chunks.select("id", text.alias("embed_text"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split('# ' || replace(text, '. ', chr(10) || '## '), chr(10))) AS line, generate_subscripts(string_split('# ' || replace(text, '. ', chr(10) || '## '), chr(10)), 1) - 1 AS n FROM documents),
    s AS (SELECT doc_id, n::INT AS n, trim(line) AS t FROM l), h AS (SELECT doc_id, n, length(regexp_extract(t, '^#+')) AS level, trim(ltrim(t, '#')) AS title FROM s WHERE t LIKE '#%')
    SELECT doc_id, n, level, title, regexp_replace(replace(lower(title), ' ', '-'), '[^\\p{L}\\p{N}-]', '', 'g') AS slug FROM h WHERE title <> ''""")
def markdown_toc(v: Views) -> DataFrame:
    """Headings of Markdown with level and anchor."""
    source = F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit("\n## ")))
    lines = v.table("documents").select("doc_id", F.posexplode(F.split(source, "\n")).alias("n", "line")).select("doc_id", "n", F.trim("line").alias("t")).where("t LIKE '#%'")
    heads = lines.select("doc_id", "n", F.length(F.regexp_extract("t", "^#+", 0)).alias("level"), F.trim(F.regexp_replace("t", "^#+", "")).alias("title")).where("title <> ''")
    return heads.withColumn("slug", F.regexp_replace(F.replace(F.lower("title"), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}-]", ""))


@query("SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'revoked' WHEN epoch(ts)::BIGINT + 86400 * (user_id % 20) <= 1706000000 THEN 'expired' WHEN event_id % 4 >= greatest(user_id % 3, 1) THEN 'exhausted' ELSE 'active' END AS state, least(1706000000 + 43200, epoch(ts)::BIGINT + 86400 * (user_id % 20)) AS session_end FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)")
def code_state(v: Views, now: int = 1_706_000_000, session: int = 43_200) -> DataFrame:
    """An access code's state, the first that holds; a session ends with its time or its code's, whichever is earlier."""
    expires = F.unix_timestamp("ts") + 86400 * (F.col("user_id") % 20)
    state = F.when(F.col("user_id") % 10 == 0, "revoked").when(expires <= now, "expired").when(F.col("event_id") % 4 >= F.greatest(F.col("user_id") % 3, F.lit(1)), "exhausted").otherwise("active")
    return v.table("events").select("event_id", state.alias("state"), F.least(F.lit(now + session), expires).alias("session_end"))


@query("WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x' || user_id WHEN 1 THEN '' || user_id WHEN 2 THEN '-' || user_id ELSE (user_id * 100) || '' END AS raw FROM events) SELECT event_id, least(greatest(coalesce(try_cast(raw AS BIGINT), 50), 1), 1000) AS clamped FROM r")
def clamp_parse(v: Views) -> DataFrame:
    """A number from text, within bounds; a default where there is none."""
    user = F.col("user_id").cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x"), user)).when(F.col("event_id") % 4 == 1, user).when(F.col("event_id") % 4 == 2, F.concat(F.lit("-"), user)).otherwise((F.col("user_id") * 100).cast("string"))
    return v.table("events").select("event_id", F.least(F.greatest(F.coalesce(raw.try_cast("bigint"), F.lit(50)), F.lit(1)), F.lit(1000)).alias("clamped"))


@query("WITH p AS (SELECT unnest(string_split('src3,src1,nope,src7', ',')) AS key, generate_subscripts(string_split('src3,src1,nope,src7', ','), 1) AS pos) SELECT pos - 1 AS pos, key, n FROM p JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) s ON s.source = key")
def enabled_sources(v: Views, keys: str = "src3,src1,nope,src7") -> DataFrame:
    """The sources that a list names, in its order; unknown ones fall out, ``all`` names each."""
    known = v.table("documents").groupBy("source").agg(F.count("*").alias("n"))
    if keys == "all":
        return known.select(F.row_number().over(W.orderBy("source")).alias("pos"), F.col("source").alias("key"), "n")
    wanted = known.sparkSession.range(1).select(F.posexplode(F.split(F.lit(keys), ",")).alias("pos", "key"))
    return known.join(F.broadcast(wanted), F.col("source") == F.col("key")).select("pos", "key", "n")


@query("WITH j AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN text || ' ![a](http://i.example.com/1.png) [b](https://s.example.com/2)' ELSE text END AS t FROM conversations) SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS links FROM j")
def count_links(v: Views) -> DataFrame:
    """Markdown links, without images."""
    text = F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit(" ![a](http://i.example.com/1.png) [b](https://s.example.com/2)"))).otherwise(F.col("text"))
    return v.table("conversations").select("conv_id", "turn", F.size(F.regexp_extract_all(text, F.lit(r"(?<!!)(\[[^\]]+\]\(https?://[^)]+\))"), F.lit(1))).alias("links"))


@query(r"""SELECT conv_id, turn, array_to_string(list_append(regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)', 1), 'http://a/' || turn || '.png'), '|') AS images, '[A](http://s/' || conv_id || ')|B' AS sources,
    sha256(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\s+$', '')) AS body_sha FROM conversations WHERE role = 'assistant'""")
def parse_suffix(v: Views) -> DataFrame:
    """An answer's parts: images, the listed sources, and the text before them."""
    made = F.concat("text", F.lit("\n\n![Bild](http://a/"), "turn", F.lit(".png)\n\nQuellen:\n- [A](http://s/"), "conv_id", F.lit(")\n- B\n"))
    block = F.regexp_extract("t", r"(?ms)^Quellen:\s*\n((?:- .+?\n?)+)\z", 1)
    rows = v.table("conversations").where("role = 'assistant'").select("conv_id", "turn", made.alias("t"))
    return rows.select(
        "conv_id", "turn",
        F.array_join(F.regexp_extract_all("t", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), "|").alias("images"),
        F.array_join(F.transform(F.filter(F.split(block, "\n"), lambda x: x.startswith("- ")), lambda x: F.trim(F.substr(x, F.lit(3)))), "|").alias("sources"),
        F.sha2(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"(?ms)^Quellen:.*\z", ""), r"!\[[^\]]*\]\([^)]+\)", ""), r"\s+\z", ""), 256).alias("body_sha"),
    )
