"""From documents to chunks: sentences, sections, tables, layout trees, web pages, embeddings."""

from __future__ import annotations

import contextlib
import json
import math
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.dom import Page, listed
from tessella.operators.text import ELEMENT_TYPES, JUNK, NORM, WIDTH_MARK, bare_image_url, element_type, embedding_input, image_urls
from tessella.plans.arrow import slices
from tessella.registry import query
from tessella.sources.views import Views

CHUNK, OVERLAP = 1500, 200
#: A table stays whole up to this many characters.
TABLE = 4 * CHUNK
#: Between the headings of a breadcrumb, and what a section says that goes on from the page before (fixed values).
CRUMB, GOES_ON = " › ", " (Forts.)"


def sentences(text: str) -> Iterator[str]:
    """Sentences of all paragraphs: they end in ``.``, ``!`` or ``?`` before white space and a capital."""
    for paragraph in re.split(r"\n\s*\n+", re.sub(r"[^\S\n]+", " ", text)):
        for sentence in re.split(r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])", paragraph.strip()):
            if sentence.strip():
                yield sentence.strip()


def split_sentences(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunks of whole sentences, each beginning with the end of the one before; what is too long is cut by length.

    A chunk is closed when the next sentence and a space would not fit. The carried end may push a chunk over ``size``; it
    is then cut into pieces of ``size`` that start ``size - overlap`` apart, at least one character.
    """
    whole: list[str] = []
    open_ = ""
    for sentence in sentences(text or ""):
        if open_ and len(open_) + 1 + len(sentence) > size:
            whole.append(open_)
            open_ = open_[len(open_) - overlap :] if 0 < overlap < len(open_) else open_ if overlap else ""
        open_ = f"{open_} {sentence}".strip()
    whole += [open_] if open_ else []
    step = max(size - overlap, 1)
    return [c[a : a + size] for c in whole for a in (range(0, len(c), step) if len(c) > size else (0,))]


def starts_within(sizes: list[int], room: int) -> list[int]:
    """Where groups begin if each in turn takes as many of ``sizes`` as ``room`` holds, and one at least."""
    ends, starts, at = np.cumsum(sizes), [], 0
    while at < len(ends):
        starts.append(at)
        at = max(at + 1, int(np.searchsorted(ends, room + (ends[at - 1] if at else 0), "right")))
    return starts


def table_parts(table: str | None, limit: int, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    """(text, strategy): a table whole if ``limit`` holds it, else its rows in groups, each under the two header lines.

    Line ends do not count for a group. A table without rows is cut like text.
    """
    if not table or not table.strip():
        return []
    if len(table) <= limit:
        return [(table, "intact")]
    head, rows = np.split(np.array([x for x in table.splitlines() if x.strip()], object), [2])
    if not len(rows):
        return [(part, "sentence_fallback") for part in split_sentences(table, size, overlap)]
    cuts = [*starts_within(list(map(len, rows)), limit - len("\n".join(head))), len(rows)]
    return [("\n".join([*head, *rows[a:b]]), "row_groups") for a, b in pairwise(cuts)]


def breadcrumb(heads: list[tuple[int | None, str | None]]) -> list[str]:
    """The titles that stand after headings (level, title): those that no later one of their level or a higher rank ended."""
    titles, rank = [], math.inf
    for level, title in reversed(heads):
        if (level or 1) < rank:
            rank = level or 1
            titles += [title] if title else []
    return titles[::-1]


def sections(kinds: list[str], pages: list[int], levels: list[int | None], contents: list[str | None], size: int = CHUNK, overlap: int = OVERLAP, limit: int = TABLE) -> list[dict]:
    """Chunks of a document's elements, which are given in order: texts of a page under their headings, tables, images.

    A block is an element that is no text, or all texts in a row on one page; what is skipped or empty does not count. A block of
    texts is cut where ``size`` is full. It goes on from a page before if the block ahead of it is one of texts too.
    """
    kind, page = np.array(kinds, object), np.array(pages)
    text = ~np.isin(kind, ["heading", "image", "table"])
    used = np.flatnonzero((kind != "_skip") & (~text | np.array([bool(c) for c in contents], bool)))
    if not len(used):
        return []
    kind, page, text = kind[used], page[used], text[used]
    parted = ~text[1:] | ~text[:-1] | (page[1:] != page[:-1])
    out, heads = [], []
    for block in np.split(np.arange(len(used)), np.flatnonzero(parted) + 1):
        at = used[block]
        first, here = contents[at[0]], int(page[block[0]])
        if kind[block[0]] == "heading":
            heads.append((levels[at[0]], first))
            continue
        path = breadcrumb(heads)
        crumb = CRUMB.join(path)
        if kind[block[0]] == "image":
            found = [(None, "image")]
        elif kind[block[0]] == "table":
            ahead = f"{crumb}\n\n" if crumb else ""
            found = [(ahead + part, how) for part, how in table_parts(first, limit - len(ahead), size, overlap)]
        else:
            found = []
            texts = [contents[i] for i in at]
            for a, b in pairwise([*starts_within(list(map(len, texts)), size), len(texts)]):
                on = a == 0 and block[0] > 0 and bool(text[block[0] - 1])
                whole = (f"{crumb}{GOES_ON if on else ''}\n\n" if crumb else "") + "\n\n".join(texts[a:b])
                fits = len(whole) <= size
                found += [(whole, "page_continuation" if on else "size")] if fits else [(part, "sentence_fallback") for part in split_sentences(whole, size, overlap)]
        kept = "image" if kind[block[0]] == "image" else "text"
        out += [{"chunk_type": kept, "page": here, "content": content, "strategy": how, "heading_path": path} for content, how in found]
    return out


def text_of(node: object) -> str:
    """The text of a layout node and of all below it, in reading order, however deep they lie."""
    found, waiting = [], [node]
    while waiting:
        at = waiting.pop()
        if isinstance(at, dict):
            found.append(at["content"].strip() if isinstance(at.get("content"), str) else "")
            waiting += reversed(at.get("kids") or [])
    return " ".join(filter(None, found))


def cells_of(node: dict) -> list[list[dict]]:
    """A table node's rows of cells with their texts and widths."""
    width = lambda cell: max(int(cell.get("column span") or cell.get("columnSpan") or 1), 1)
    return [[{"text": text_of(cell), "span": width(cell)} for cell in row.get("cells") or []] for row in node.get("rows") or []]


def items_of(node: dict) -> list[str]:
    return [text_of(item) for item in node.get("list items") or node.get("items") or []]


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def table_markdown(cells: Column) -> Column:
    """Rows of (text, span) as Markdown: a wide cell is followed by empty ones, short rows are filled up, the first is the head."""
    shown = lambda cell: F.trim(F.replace(F.replace(cell["text"], F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit(" ")))
    lines = F.transform(cells, lambda row: F.flatten(F.transform(row, lambda cell: F.concat(F.array(shown(cell)), F.array_repeat(F.lit(""), cell["span"] - 1)))))
    written = lambda line: F.concat(F.lit("| "), F.array_join(line, " | "), F.lit(" |"))

    def ruled(lines: Column, columns: Column) -> Column:
        full = F.transform(lines, lambda line: written(F.concat(line, F.array_repeat(F.lit(""), columns - F.size(line)))))
        rule = F.array(written(F.array_repeat(F.lit("---"), columns)))
        return _with(full, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), rule, F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1)))), "\n"))

    widest = lambda lines: F.coalesce(F.array_max(F.transform(lines, F.size)), F.lit(0))
    return _with(lines, lambda x: _with(widest(x), lambda columns: F.when(columns == 0, "").otherwise(ruled(x, columns))))


def list_markdown(items: Column) -> Column:
    return F.array_join(F.transform(F.filter(items, lambda item: item != ""), lambda item: F.concat(F.lit("- "), item)), "\n")


def box(node: Column) -> Column:
    """The four numbers of a JSON node's box; null where there are not four, or not all are numbers."""
    edges = F.transform(F.from_json(node, "struct<`bounding box`:array<string>>")["bounding box"], lambda x: x.try_cast("double"))
    return F.when((F.size(edges) == 4) & F.forall(edges, lambda x: x.isNotNull()), edges)


NODES = "array<struct<kind:string,page:int,level:int,node:string,text:string,items:array<string>,cells:array<array<struct<text:string,span:int>>>>>"


NODES_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("page", pa.int32()), ("level", pa.int32()), ("node", pa.string()), ("text", pa.string()), ("items", pa.list_(pa.string())), ("cells", pa.list_(pa.list_(pa.struct([("text", pa.string()), ("span", pa.int32())]))))]))


def number(value: object, default: int) -> int:
    """A whole number from a layout node, which may be written as text; the default for what is none."""
    try:
        return int(value) if value else default
    except (TypeError, ValueError):
        return default


def heading_level(node: dict, raw: str) -> int:
    """A heading's level as the node states it, else the digit in its type, else 1."""
    stated = node.get("heading level") or node.get("headingLevel") or node.get("level")
    return number(stated or next((c for c in raw if c.isdigit()), None), 1)


def leaves(tree: dict) -> list[dict]:
    """Elements of a layout tree below its root, in reading order, not yet rendered.

    A header, footer or caption is left out with all below it; an image, table or list is one element with all below it. A
    heading or text is an element of its own content, or without any of the text below it, and what is below it follows. A
    type that is missing or not known is text; text without content is no element.
    """
    found, waiting = [], list(reversed(tree.get("kids") or []))
    while waiting:
        node = waiting.pop()
        if not isinstance(node, dict):
            continue
        raw = str(node.get("type") or "").lower()
        kind = ELEMENT_TYPES.get(raw, "text")
        if kind == "_skip":
            continue
        leaf = {"kind": kind, "page": number(node.get("page number") or node.get("pageNumber"), 1), "level": None, "node": json.dumps({"bounding box": node.get("bounding box")}), "text": None, "items": None, "cells": None}
        if kind == "table":
            found.append(leaf | {"cells": cells_of(node)})
        elif kind == "list":
            found.append(leaf | {"items": items_of(node)})
        elif kind == "image":
            found.append(leaf)
        else:
            content = node.get("content")
            text = (content if isinstance(content, str) and content else text_of(node)).strip()
            if kind == "heading":
                found.append(leaf | {"text": text, "level": heading_level(node, raw)})
            elif text:
                found.append(leaf | {"text": text})
            waiting += reversed(node.get("kids") or [])
    return found


# What follows applies these to DataFrames; a document is one row or one small group of rows.


@query()
def chunk_documents(v: Views) -> DataFrame:
    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(split_sentences)

    rows = v.table("documents").select("doc_id", F.posexplode(chunks("text")).alias("n", "chunk"))
    return rows.select("doc_id", "n", F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("sha"))


def elements(v: Views) -> DataFrame:
    """Documents with ``els``, their lines as layout elements in order: headings, texts, tables and images over pages."""

    def element(line: Column, at: Column) -> Column:
        kind = F.when(at % 9 == 0, "h2").when(at % 9 == 4, "table").when(at % 9 == 7, "picture").when(at % 9 == 8, "footer").otherwise("paragraph")
        rows = F.array_join(F.transform(F.split(line, " "), lambda w: F.concat(F.lit("| "), w, F.lit(" | 1 |"))), "\n")
        content = F.when(kind == "table", F.concat(F.lit("| a | b |\n| --- | --- |\n"), rows)).when(kind != "picture", line)
        level = F.when(kind == "h2", 1 + F.floor(at / 9).cast("int") % 3)
        return F.struct(at.alias("ord"), element_type(kind).alias("kind"), (1 + F.floor(at / 5)).cast("int").alias("page"), content.alias("content"), level.alias("level"))

    return v.table("documents").select("doc_id", F.transform(F.split("text", "\n"), element).alias("els"))


@query()
def layout_to_chunks(v: Views) -> DataFrame:
    """A document is one row, and so are its elements: no text is shuffled."""

    @F.pandas_udf("array<struct<chunk_type:string,page:int,content:string,strategy:string,heading_path:array<string>>>")
    def chunked(kinds: pd.Series, pages: pd.Series, levels: pd.Series, contents: pd.Series) -> pd.Series:
        whole = lambda x: None if x is None or x != x else int(x)
        rows = zip(kinds, pages, levels, contents, strict=True)
        return pd.Series([sections(list(k), list(p), [whole(x) for x in n], list(c)) for k, p, n, c in rows], dtype=object)

    found = elements(v).select("doc_id", F.posexplode(chunked("els.kind", "els.page", "els.level", "els.content")).alias("n", "c"))
    return found.select("doc_id", "n", "c.*")


@query()
def table_chunks(v: Views) -> DataFrame:
    @F.pandas_udf("array<struct<content:string,strategy:string>>")
    def parts(tables: pd.Series) -> pd.Series:
        return tables.map(lambda t: [{"content": c, "strategy": s} for c, s in table_parts(t, 600)])

    tables = elements(v).select("doc_id", F.explode(F.filter("els", lambda e: e["kind"] == "table")).alias("e"))
    return tables.select("doc_id", "e.ord", F.inline(parts("e.content")))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS title FROM documents),
    h AS (SELECT doc_id, ord, title, 1 + (ord // 9) % 3 AS level FROM l WHERE ord % 9 = 0)
    SELECT a.doc_id, a.ord, string_agg(b.title, ' › ' ORDER BY b.ord) AS path FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.ord <= a.ord AND a.title <> '' AND b.title <> ''
    AND NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = b.doc_id AND c.ord > b.ord AND c.ord <= a.ord AND c.level <= b.level) GROUP BY 1, 2""")
def heading_path(v: Views) -> DataFrame:
    """The breadcrumb of each heading, itself last: a heading ends those of its level and below."""
    head = "struct<ord:int,level:int,title:string>"
    heads = F.transform(F.filter("els", lambda e: e["kind"] == "heading"), lambda e: F.struct(e["ord"].alias("ord"), e["level"].alias("level"), e["content"].alias("title")).cast(head))

    def step(state: Column, e: Column) -> Column:
        standing = F.array_append(F.filter(state["standing"], lambda h: h["level"] < e["level"]), e)
        path = F.array_join(F.transform(F.filter(standing, lambda h: h["title"] != ""), lambda h: h["title"]), CRUMB)
        return F.struct(standing.alias("standing"), F.array_append(state["paths"], path).alias("paths"))

    start = F.struct(F.array().cast(f"array<{head}>").alias("standing"), F.array().cast("array<string>").alias("paths"))
    rows = elements(v).select("doc_id", heads.alias("heads")).select("doc_id", F.inline(F.arrays_zip("heads", F.aggregate("heads", start, step)["paths"].alias("path"))))
    return rows.where("heads.title <> ''").select("doc_id", "heads.ord", "path")


def trees(v: Views) -> DataFrame:
    """Layout trees as JSON, one a document: a page of all its lines, a list of all its words and a table of them, six a row.

    The first line is also a heading with a text below it, the last a footer's, an untyped node's and that of a text with no content
    of its own. The boxes of some have only three numbers, of others no numbers.
    """
    words, lines = F.split("text", " "), F.split("text", "\n")
    edges = F.when(F.col("doc_id") % 3 == 1, F.array(*map(F.lit, "123"))).when(F.col("doc_id") % 3 == 2, F.array(*map(F.lit, "1x34"))).otherwise(F.array(F.lit("1"), F.lit("2"), F.col("doc_id").cast("string"), F.lit("4")))
    leaf = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"), F.lit(1).alias("page number"), edges.alias("bounding box"))
    paragraphs = F.array_join(F.transform(lines, lambda x: F.to_json(leaf("paragraph", x))), ",")
    last = F.element_at(lines, -1)
    head = F.to_json(leaf("h1", lines[0]))
    under = lambda kind, content: F.struct(F.lit(kind).alias("type"), F.lit("3").alias("pageNumber"), content.alias("content"))
    nested = F.to_json(F.struct(F.lit("h3").alias("type"), lines[0].alias("content"), F.array(under("paragraph", last), under("caption", last)).alias("kids")))
    footer = F.to_json(F.struct(F.lit("footer").alias("type"), F.array(under("paragraph", last)).alias("kids")))
    untyped = F.to_json(F.struct(last.alias("content"), F.array(F.struct(F.lit("png").alias("type"))).alias("kids")))
    empty = F.to_json(F.struct(F.lit("paragraph").alias("type"), F.array(under("blink", last)).alias("kids")))
    items = F.to_json(F.struct(F.lit("ul").alias("type"), F.transform("words", lambda w: F.struct(w.alias("content"))).alias("list items")))
    row = lambda i: F.struct(F.transform(F.slice(F.col("words"), i * 6 + 1, F.lit(6)), lambda w: F.struct(w.alias("content"))).alias("cells"))
    cells = F.to_json(F.transform(F.sequence(F.lit(0), F.expr("(size(words) - 1) div 6").cast("int")), row))
    grid = F.concat(F.lit('{"type":"table","rows":'), F.regexp_replace(cells, r"\]$", ""), F.lit(',{"cells":[{"content":"a|b","column span":2}]}]}'))
    kids = F.concat(F.lit('{"kids":['), F.concat_ws(",", head, paragraphs, items, grid, nested, footer, untyped, empty), F.lit("]}"))
    return v.table("documents").withColumn("words", words).select("doc_id", kids.alias("tree"))


def rendered(v: Views) -> DataFrame:
    """Each element of the trees: its place, kind, page, level, box and content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [None if t is None else leaves(json.loads(t)) for t in part["tree"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found, NODES_ARROW)], ["doc_id", "els"])

    content = F.when(F.col("e.kind") == "table", table_markdown(F.col("e.cells"))).when(F.col("e.kind") == "list", list_markdown(F.col("e.items"))).otherwise(F.col("e.text"))
    rows = trees(v).select(F.col("doc_id").cast("long").alias("doc_id"), "tree").mapInArrow(read, f"doc_id long, els {NODES}").select("doc_id", F.posexplode("els").alias("ord", "e"))
    return rows.select("doc_id", "ord", "e.kind", "e.page", "e.level", box(F.col("e.node")).alias("bbox"), content.alias("content"))


FLAT = """d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, string_split(text, ' ') AS ws FROM documents),
    cut AS (SELECT doc_id, ls, trim(ls[1], ' ' || chr(9) || chr(13)) AS head, trim(ls[len(ls)], ' ' || chr(9) || chr(13)) AS last, list_transform(ws, lambda w: trim(w, ' ' || chr(9) || chr(10) || chr(13))) AS ws FROM d),
    parts AS (SELECT doc_id, list_filter(list_transform(ls, lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '') AS ls, head, last, list_filter(ws, lambda w: w <> '') AS items,
        list_transform(ws, lambda w: replace(replace(w, '|', '\\|'), chr(10), ' ')) AS cells FROM cut),
    grid AS (SELECT *, least(len(cells), 6)::INT AS wide, list_transform(range((len(cells) + 5) // 6), lambda i: cells[6 * i + 1 : 6 * i + 6]) AS rows FROM parts),
    drawn AS (SELECT *, greatest(wide, 2) AS width, list_transform(list_append(rows, ['a\\|b', '']), lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(greatest(greatest(wide, 2) - len(r), 0)), lambda i: '')), ' | ') || ' |') AS lines FROM grid),
    found AS (SELECT doc_id, unnest(list_concat([{'kind': 'heading', 'page': 1, 'level': 1, 'content': head}], list_transform(ls, lambda l: {'kind': 'text', 'page': 1, 'level': NULL, 'content': l}),
        [{'kind': 'list', 'page': 1, 'level': NULL, 'content': array_to_string(list_transform(items, lambda w: '- ' || w), chr(10))},
         {'kind': 'table', 'page': 1, 'level': NULL, 'content': array_to_string(list_concat(lines[1:1], ['| ' || array_to_string(list_transform(range(width), lambda i: '---'), ' | ') || ' |'], lines[2:]), chr(10))},
         {'kind': 'heading', 'page': 1, 'level': 3, 'content': head}],
        CASE WHEN last <> '' THEN [{'kind': 'text', 'page': 3, 'level': NULL, 'content': last}, {'kind': 'text', 'page': 1, 'level': NULL, 'content': last}] ELSE [] END,
        [{'kind': 'image', 'page': 1, 'level': NULL, 'content': NULL}],
        CASE WHEN last <> '' THEN [{'kind': 'text', 'page': 1, 'level': NULL, 'content': last}, {'kind': 'text', 'page': 3, 'level': NULL, 'content': last}] ELSE [] END)) AS e FROM drawn)"""


@query(f"WITH {FLAT} SELECT doc_id, e.kind, e.page, e.level, md5(e.content) AS content_md5, count(*) AS n FROM found GROUP BY ALL")
def layout_flatten(v: Views) -> DataFrame:
    """Elements of layout trees, and how many of a document are alike."""
    return rendered(v).select("doc_id", "kind", "page", "level", F.md5(F.encode("content", "utf-8")).alias("content_md5")).groupBy("doc_id", "kind", "page", "level", "content_md5").agg(F.count("*").alias("n"))


#: What an article is looked for in at last (fixed value).
DEFAULT_ARTICLE = "article, main"


def html_text(page: str | None, within: str | None = None, strip: tuple[str, ...] = ()) -> str:
    """Text of a page, or of each element that a selector finds in it, without what ``strip`` finds; a line for each string."""
    read = Page(page)
    without = [e for s in strip for e in read.select(s)]
    parts = [read.text(e, without) for e in read.select(within)] if within else [read.text(None, without)]
    return "\n\n".join(p for p in parts if p)


def article_body(page: str | None, selectors: tuple[str, ...], strip: tuple[str, ...] = (), least: int = 100) -> str | None:
    """The text of the first selector that finds ``least`` characters or more; none if no selector does.

    Lists count as their selectors one after the other; the default comes last, as a whole. What is no selector finds nothing.
    """
    for selector in [*(x for s in selectors for x in listed(s)), DEFAULT_ARTICLE]:
        with contextlib.suppress(ValueError):
            if len(text := html_text(page, selector, strip)) >= least:
                return text
    return None


def page_images(page: str | None, selector: str) -> list[str]:
    """URLs of the images that a selector finds, from ``src`` or ``data-src``: absolute, not junk, each image once at its widest."""
    best: dict[str, tuple[int, str]] = {}
    for e in Page(page).select(selector):
        url = e.attrs.get("src") or e.attrs.get("data-src") or ""
        if url.startswith("http") and not any(mark in url.lower() for mark in JUNK):
            wide = int(m[1]) if (m := WIDTH_MARK.search(url)) else 0
            key = bare_image_url(url)
            if key not in best or wide > best[key][0]:
                best[key] = (wide, url)
    return [url for _, url in best.values()]


@query()
def html_to_text(v: Views) -> DataFrame:

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part["page_id"], pa.array([html_text(p) for p in part["html"].to_pylist()], pa.string())], ["page_id", "text"])

    return v.table("pages").select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(read, "page_id long, text string")


@query(f"WITH {NORM}, ok AS (SELECT * FROM norm WHERE NOT regexp_matches(lower(image_url), '\\.svg|vgwort\\.de|/pixel|/tracking|/beacon') AND starts_with(image_url, 'http')) SELECT page_id, image_url FROM ok QUALIFY row_number() OVER (PARTITION BY page_id, base ORDER BY width DESC, pos) = 1")
def article_images(v: Views) -> DataFrame:
    """Images of pages, here ones that are put at the end of each given page, as those have none."""

    @F.pandas_udf("array<string>")
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: page_images(p, "figure > img, div.gallery img[data-src]"))

    put = F.concat(F.lit("<div class='gallery'>"), F.array_join(F.transform("urls", lambda u: F.concat(F.when(u.contains("_w960"), F.lit("<p><img src='' data-src=\"")).otherwise(F.lit("<figure><img src=\"")), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("\"></figure>"))), ""), F.lit("</div>"))
    urls = image_urls(v).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "image_url"))), lambda x: x["image_url"]).alias("urls"))
    pages = v.table("pages").select("page_id", "html").join(urls, "page_id")
    return pages.select("page_id", F.explode(found(F.concat("html", put))).alias("image_url"))


@query()
def extract_article(v: Views) -> DataFrame:
    """The text that selectors find, without what is stripped, if it has a hundred characters; else the feed's content; else its summary."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, pages = part["page_id"].to_pylist(), part["html"].to_pylist()
            a = [article_body(p, ("div.story", "article"), ("h1", ".ad")) if i is not None and i % 5 else None for i, p in zip(ids, pages, strict=True)]
            b = [html_text(p) if i is not None and i % 10 and len(x or "") < 100 else None for i, p, x in zip(ids, pages, a, strict=True)]
            yield pa.RecordBatch.from_arrays([part["page_id"], pa.array(a, pa.string()), pa.array(b, pa.string()), part["c"]], ["page_id", "a", "b", "c"])

    pages = v.table("pages").select(F.col("page_id").cast("long").alias("page_id"), "html", F.concat(F.lit("summary of "), "url").alias("c"))
    tiers = pages.mapInArrow(read, "page_id long, a string, b string, c string")
    long = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) >= 100
    return tiers.select("page_id", F.when(long("a"), 1).when(long("b"), 2).otherwise(3).alias("tier"), F.when(long("a"), F.col("a")).when(long("b"), F.col("b")).otherwise(F.col("c")).alias("text"))


@query("""WITH n AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || filename)) AS h FROM docs)
    SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(('0x' || h[17])::INT & 3) + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM n""")
def uuid5_ids(v: Views) -> DataFrame:
    return v.docs.select("doc_id", uuid5(F.concat(F.lit("doc:"), "filename")).alias("uuid"))


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The version 5 UUID of a name: a SHA-1 with the nibbles of version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def embed_all(texts: list[str], embedder: Callable[[list[str]], list]) -> list:
    """Vectors of a batch. A batch that fails is halved until the texts that fail stand alone; they get none."""
    try:
        return list(embedder(texts))
    except Exception:
        if len(texts) <= 1:
            return [None] * len(texts)
        middle = len(texts) // 2
        return embed_all(texts[:middle], embedder) + embed_all(texts[middle:], embedder)


def embed_texts(df: DataFrame, text_col: str, embedder: Callable[[list[str]], list], batch: int = 10) -> DataFrame:
    """``df`` with ``vector``, null where the text is unfit (see ``embedding_input``) or the embedder fails on it."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            fit = texts[texts.notna()]
            found = [x for a in range(0, len(fit), batch) for x in embed_all(fit.iloc[a : a + batch].tolist(), embedder)]
            yield pd.Series(found, index=fit.index, dtype=object).reindex(texts.index).map(lambda x: x if isinstance(x, list) else None)

    return df.withColumn("vector", vectors(embedding_input(F.col(text_col))))


def letter_shares(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: a few letters' shares. It fails on texts in capitals, to show that others do not suffer."""
    if any("!!" in t for t in texts):
        raise ValueError("text refused")
    return [[t.count(c) / len(t) for c in "aeiou"] for t in texts]


@query()
def embed_resilient(v: Views) -> DataFrame:
    return embed_texts(v.table("documents").select("doc_id", "text"), "text", letter_shares).select("doc_id", "vector")


@query("SELECT event_id AS req_id, value AS ms, user_id, event_type FROM events WHERE event_id % 50 <> 0")
def trace_scan(v: Views) -> DataFrame:
    """Traces, one JSON object a line; lines that are none are passed over."""
    line = F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_id").alias("req_id"), F.col("value").alias("ms"), F.struct("user_id", "event_type").alias("filters"))))
    lines = v.table("events").select(line.alias("value"))
    parsed = lines.select(F.from_json("value", "req_id bigint, ms double, filters struct<user_id:bigint,event_type:string>, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("t"))
    return parsed.where("t._bad IS NULL").select("t.req_id", "t.ms", "t.filters.user_id", "t.filters.event_type")


@query("SELECT event_id, user_id AS id, 1 AS n FROM events UNION ALL SELECT event_id, user_id, 2 FROM events WHERE event_id % 3 <> 1")
def json_or_ndjson(v: Views) -> DataFrame:
    """Listings that are a JSON array, one object, or an object a line."""
    one = lambda n: F.to_json(F.struct(F.col("user_id").alias("id"), F.lit(n).alias("n")))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), one(1), F.lit(","), one(2), F.lit("]"))).when(F.col("event_id") % 3 == 1, one(1)).otherwise(F.concat(one(1), F.lit("\n\n"), one(2), F.lit("\n")))
    rows = v.table("events").select("event_id", F.trim(raw).alias("raw"))
    lines = F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != "")
    text = F.when(F.col("raw").startswith("["), F.col("raw")).otherwise(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")))
    return rows.select("event_id", F.inline(F.from_json(text, "array<struct<id:bigint,n:int>>")))


@query("""WITH i AS (SELECT id, doc_id, caption, 30 * length(coalesce(caption, '')) AS bytes, 100 + id % 200 AS width FROM chunks WHERE chunk_type = 'image')
    SELECT min(id) AS id, arg_min(doc_id, id) AS doc_id FROM i WHERE width >= 150 AND bytes >= 5120 GROUP BY caption""")
def image_guard(v: Views) -> DataFrame:
    """Images large enough to keep, each content once."""
    size = F.length(F.coalesce("caption", F.lit("")))
    images = v.chunks.where("chunk_type = 'image'").select("id", "doc_id", F.sha2("caption", 256).alias("sha"), (size * 30).alias("bytes"), (100 + F.col("id") % 200).alias("width"))
    kept = images.where("width >= 150 AND bytes >= 5120")
    return kept.groupBy("sha").agg(F.min(F.struct("id", "doc_id")).alias("first")).select("first.id", "first.doc_id")


_WORDS = "w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS w FROM documents)"


@query(f"""WITH {_WORDS}, c AS (SELECT doc_id, list_transform(w, lambda x: trim(replace(replace(x, '|', '\\|'), chr(10), ' '))) AS c FROM w),
    r AS (SELECT doc_id, greatest(least(len(c), 6), 2) AS k, list_append(list_transform(range((len(c) - 1) // 6 + 1), lambda i: c[6 * i + 1:6 * i + 6]), ['a\\|b', '']) AS rows FROM c),
    l AS (SELECT doc_id, k, list_transform(rows, lambda x: '| ' || array_to_string(list_concat(x, list_transform(range(k - len(x)), lambda i: '')), ' | ') || ' |') AS l FROM r)
    SELECT doc_id, array_to_string(list_concat(l[1:1], ['|' || repeat(' --- |', k::INT)], l[2:]), chr(10)) AS md FROM l""", name="table_markdown")
def tables_as_markdown(v: Views) -> DataFrame:
    return rendered(v).where("kind = 'table'").select("doc_id", F.col("content").alias("md"))


@query(f"WITH {_WORDS} SELECT doc_id, array_to_string(list_transform(list_filter(w, lambda x: x <> ''), lambda x: '- ' || x), chr(10)) AS md FROM w", name="list_markdown")
def lists_as_markdown(v: Views) -> DataFrame:
    return rendered(v).where("kind = 'list'").select("doc_id", F.col("content").alias("md"))


@query("SELECT doc_id, len(string_split(text, chr(10))) + 7 AS nodes, CASE WHEN doc_id % 3 = 0 THEN len(string_split(text, chr(10))) + 1 ELSE 0 END AS boxes, CASE WHEN doc_id % 3 = 0 THEN doc_id::DOUBLE END AS third FROM documents")
def bbox_parse(v: Views) -> DataFrame:
    """Boxes of all nodes of the layout trees' pages as four numbers; null where they are not."""
    nodes = trees(v).select("doc_id", F.explode(F.from_json(F.get_json_object("tree", "$.kids"), "array<string>")).alias("node")).select("doc_id", box(F.col("node")).alias("b"))
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count("b").alias("boxes"), F.max(F.col("b")[2]).alias("third"))
