"""Entries of whole feeds: RSS 2.0, RDF and Atom documents."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.arrow import arrow_rows
from tessella.plans.lineage import cut
from tessella.registry import query
from tessella.sources.views import Views

#: Namespaces of feeds (fixed values).
ATOM, CONTENT, DC = "{http://www.w3.org/2005/Atom}", "{http://purl.org/rss/1.0/modules/content/}", "{http://purl.org/dc/elements/1.1/}"
RSS = ("", "{http://purl.org/rss/1.0/}", "{http://backend.userland.com/rss2}", "{http://my.netscape.com/rdf/simple/0.9/}")
ENTRIES = {f"{ns}item" for ns in RSS} | {f"{ATOM}entry"}

FIELDS = ("url", "title", "author", "published", "updated", "summary", "content_encoded")
ENTRY = ", ".join(f"{name} string" for name in FIELDS)
#: Feeds of an Arrow batch, and characters that are parsed at a time.
BATCH, PIECE = 16, 1 << 16


def _text(element: ElementTree.Element) -> str:
    return "".join(element.itertext()).strip()


def _content(element: ElementTree.Element) -> str:
    """Atom content: text, or the markup of an XHTML body."""
    if element.get("type") == "xhtml" and len(element):
        body = element[0]
        return ((body.text or "") + "".join(ElementTree.tostring(kid, "unicode") for kid in body)).strip()
    return _text(element)


def entry_of(item: ElementTree.Element) -> dict[str, str]:
    """An entry's fields, empty where it has none; of several of a kind the first that is not empty."""
    out = dict.fromkeys(FIELDS, "")

    def put(name: str, value: str | None) -> None:
        out[name] = out[name] or (value or "").strip()

    guid = ""
    for kid in item:
        tag = kid.tag if isinstance(kid.tag, str) else ""
        own = next((tag[len(ns) :] for ns in (*RSS[1:], ATOM) if tag.startswith(ns)), tag)
        if tag == f"{ATOM}link":
            if kid.get("rel", "alternate") == "alternate":
                put("url", kid.get("href"))
        elif tag.startswith(ATOM) and own == "author":
            put("author", kid.findtext(f"{ATOM}name") or kid.findtext(f"{ATOM}email"))
        elif tag == f"{ATOM}content":
            put("content_encoded", _content(kid))
        elif tag == f"{CONTENT}encoded":
            put("content_encoded", _text(kid))
        elif tag == f"{DC}creator":
            put("author", _text(kid))
        elif tag == f"{DC}date" or own in ("updated", "modified"):
            put("updated", _text(kid))
        elif own in ("pubDate", "published", "issued"):
            put("published", _text(kid))
        elif own in ("description", "summary"):
            put("summary", _content(kid))
        elif own == "guid" and kid.get("isPermaLink", "true").lower() == "true":
            guid = _text(kid)
        elif own == "link":
            put("url", _text(kid))
        elif own in ("title", "author"):
            put(own, _text(kid))
    put("url", guid)
    return out


def entries_of(document: bytes) -> Iterator[dict[str, str]]:
    """The entries of a feed that have a link. Of a broken document those before the break; what is no feed has none.

    The document is parsed piece by piece and an entry let go once it is read.
    """
    parser = ElementTree.XMLPullParser(("start", "end"))
    stack: list[ElementTree.Element] = []
    document = document.lstrip()
    for at in range(0, len(document), PIECE):
        try:
            parser.feed(document[at : at + PIECE])
            for event, element in parser.read_events():
                if event == "start":
                    stack.append(element)
                    continue
                stack.pop()
                if element.tag in ENTRIES and not any(e.tag in ENTRIES for e in stack):
                    entry = entry_of(element)
                    if entry["url"]:
                        yield entry
                    if stack:
                        stack[-1].remove(element)
        except (ElementTree.ParseError, ValueError, LookupError):  # an unknown encoding is a break too
            return


def feed_entries_of(feeds: DataFrame, document: Column, *keys: str) -> DataFrame:
    """``keys`` and ``FIELDS`` of each entry of each feed, with ``place``, its number in the feed. Null documents have none."""

    @F.pandas_udf(f"array<struct<{', '.join(f'{n}:string' for n in FIELDS)}>>")
    def entries(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: list(entries_of(d)) if d is not None else [])

    with arrow_rows(feeds.sparkSession, BATCH):
        return cut(feeds.select(*keys, F.posexplode(entries(document.cast("binary"))).alias("place", "e")).select(*keys, "place", "e.*"))


def read_feeds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of the feed files in ``paths``, one document each."""
    return feed_entries_of(spark.read.format("binaryFile").load(paths).select("path", "content"), F.col("content"), "path")


def escaped(text: Column) -> Column:
    """Text as XML, without the control characters that XML has no way to write."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        clean = F.replace(clean, F.lit(a), F.lit(b))
    return clean


def written_feeds(v: Views, each: int = 10) -> DataFrame:
    """Pages as feeds of ``each`` entries: RSS 2.0, RDF and Atom in turn. Every sixth page has no link."""
    url = F.when(F.col("page_id") % 6 == 0, "").otherwise(escaped(F.col("url")))
    page, html = F.col("page_id").cast("string"), escaped(F.col("html"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rss = say("<item><title>Page ", page, "</title><link>", url, "</link><author>a", page, "@example.com</author><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description>S", page, "</description><content:encoded>", html, "</content:encoded></item>")
    rdf = say("<item><title>Page ", page, "</title><link>", url, "</link><dc:creator>a", page, "@example.com</dc:creator><dc:date>2024-01-01</dc:date><description>S", page, "</description><content:encoded>", html, "</content:encoded></item>")
    atom = say('<entry><title>Page ', page, '</title><link rel="self" href="http://self/"/><link href="', url, '"/><author><name>a', page, '@example.com</name></author><published>2024-01-01T00:00:00Z</published><summary>S', page, '</summary><content type="html">', html, "</content></entry>")
    feed = F.expr(f"page_id div {each}")
    items = v.table("pages").select(feed.alias("feed"), "page_id", F.when(feed % 3 == 0, rss).when(feed % 3 == 1, rdf).otherwise(atom).alias("item"))
    kind = F.col("feed") % 3
    begin = (
        F.when(kind == 0, '<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>F</title><link>http://f/</link>')
        .when(kind == 1, '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/">')
        .otherwise('<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link href="http://f/"/>')
    )
    end = F.when(kind == 0, "</channel></rss>").when(kind == 1, "</rdf:RDF>").otherwise("</feed>")
    whole = items.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), "\n").alias("items"))
    return whole.select("feed", F.concat(begin, "items", end).alias("document"))


@query(r"""SELECT page_id // 10 AS feed, 'Page ' || page_id AS title, trim(url) AS url, 'a' || page_id || '@example.com' AS author,
    CASE page_id // 10 % 3 WHEN 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' WHEN 1 THEN '' ELSE '2024-01-01T00:00:00Z' END AS published, 'S' || page_id AS summary,
    md5(regexp_replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '^\s+|\s+$', '', 'g')) AS content_md5 FROM pages WHERE page_id % 6 <> 0 AND trim(url) <> ''""")
def feed_entries(v: Views) -> DataFrame:
    """Entries of feeds of all kinds, with whole pages as their contents, without those that have no link."""
    found = feed_entries_of(written_feeds(v), F.col("document"), "feed")
    return found.select("feed", "title", "url", "author", "published", "summary", F.md5(F.encode("content_encoded", "utf-8")).alias("content_md5"))
