import json
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import chunking as C
from tessella.operators.text import element_type, embedding_input
from tessella.plans.arrow import slices
from tessella.registry import QUERIES


def chunked(*elements, **kw):
    """Chunks of (kind, content, page, level)."""
    kinds, contents, pages, levels = map(list, zip(*elements, strict=True))
    return C.sections(kinds, pages, levels, contents, **kw)


def test_element_types(spark):
    rows = spark.createDataFrame([(x,) for x in ("Png", "TITLE", "OL", "table cell", "caption", "Li", "blink")], "t string")
    assert [r[0] for r in rows.select(element_type(F.col("t"))).collect()] == ["image", "heading", "list", "_skip", "_skip", "text", "text"]


def test_boxes(spark):
    nodes = [[7, "8", 9.5, 1e3], [7, None, 9, 1], [7, "eight", 9, 1], [7, 8, 9], [], None]
    rows = spark.createDataFrame([(n, json.dumps({"bounding box": x})) for n, x in enumerate(nodes)] + [(6, "{}"), (7, "no json"), (8, None)], "n int, node string")
    assert [r[0] for r in rows.orderBy("n").select(C.box(F.col("node"))).collect()] == [[7.0, 8.0, 9.5, 1000.0]] + [None] * 8


def test_text_of_deep_nodes():
    deep = {"content": "end"}
    for k in range(5000):
        deep = {"kids": [deep], "content": f" {k} " if k % 1000 == 0 else None}
    assert C.text_of({"content": "top", "kids": [{"content": ["no"]}, 3, deep, {"content": " last"}]}) == "top 4000 3000 2000 1000 0 end last"
    assert C.text_of(None) == C.text_of({}) == ""


def shown(spark, node):
    row = spark.createDataFrame([(C.cells_of(node), C.items_of(node))], "cells array<array<struct<text:string,span:int>>>, items array<string>")
    return tuple(row.select(C.table_markdown(F.col("cells")), C.list_markdown(F.col("items"))).first())


def test_tables_and_lists_as_markdown(spark):
    cell = lambda text, span=None: {"kids": [{"content": text}], "columnSpan": span}
    grid = {"rows": [{"cells": [cell("x"), cell("wide", 3)]}, {"cells": []}, {"cells": [cell("p|q\nr"), cell("s"), cell("t"), cell("u")]}]}
    assert shown(spark, grid)[0].split("\n") == ["| x | wide |  |  |", "| --- | --- | --- | --- |", "|  |  |  |  |", "| p\\|q r | s | t | u |"]
    assert shown(spark, {"rows": [{"cells": [cell("one")]}]})[0] == "| one |\n| --- |"
    assert shown(spark, {}) == ("", "") and shown(spark, {"rows": [{}, {"cells": []}]})[0] == ""
    assert shown(spark, {"items": [{"content": "no"}], "list items": [{"content": "b"}, {}, {"kids": [{"content": "c"}, {"content": "d"}]}]})[1] == "- b\n- c d"


def walked(node):
    """A plain walk that goes down into a node before the next."""
    raw = str(node.get("type") or "").lower()
    kind = C.ELEMENT_TYPES.get(raw, "text")
    if kind == "_skip":
        return
    page = int(node.get("page number") or node.get("pageNumber") or 1)
    below = lambda n: " ".join(x for x in [(n.get("content") or "").strip(), *map(below, n.get("kids") or [])] if x)
    own = (node.get("content") or below(node)).strip()
    if kind in ("image", "table", "list"):
        yield kind, page, None, None
        return
    digits = [c for c in raw if c.isdigit()]
    if kind == "heading":
        yield kind, page, int(node.get("heading level") or node.get("headingLevel") or node.get("level") or (digits or [1])[0]), own
    elif own:
        yield kind, page, None, own
    for kid in node.get("kids") or []:
        yield from walked(kid)


KIDS = [
    {"type": "Title", "content": "t", "heading level": 4},
    {"type": "header", "kids": [{"type": "odd", "content": "in", "page number": 8}]},
    {"type": "caption", "content": "c", "kids": [{"type": "table"}]},
    {"type": "H", "content": "Kopf", "kids": [{"type": "paragraph", "content": "body", "pageNumber": 2}, {"type": "footer", "content": "f"}]},
    {"type": "h2", "content": "two"},
    {"type": "h1", "content": "", "kids": [{"type": "text", "content": " below "}]},
    {"type": "heading", "content": "l", "headingLevel": "3"},
    {"type": "heading", "content": "l", "level": 5, "page number": "7"},
    {"content": "untyped"},
    {"kids": [{"type": "ol", "items": [{"content": "i"}]}, {"content": "deep"}]},
    {"type": "paragraph", "kids": []},
    {"type": "paragraph", "content": "  "},
    {"type": "blink", "content": "odd", "kids": [{"type": "jpg", "kids": [{"content": "no"}]}]},
]


def test_leaves_of_a_tree():
    found = [(e["kind"], e["page"], e["level"], e["text"]) for e in C.leaves({"type": "header", "content": "root", "kids": KIDS})]
    assert found == [x for kid in KIDS for x in walked(kid)]
    assert found == [
        ("heading", 1, 4, "t"), ("heading", 1, 1, "Kopf"), ("text", 2, None, "body"), ("heading", 1, 2, "two"), ("heading", 1, 1, "below"), ("text", 1, None, "below"), ("heading", 1, 3, "l"), ("heading", 7, 5, "l"),
        ("text", 1, None, "untyped"), ("text", 1, None, "deep"), ("list", 1, None, None), ("text", 1, None, "deep"), ("text", 1, None, "odd"), ("image", 1, None, None),
    ]
    assert C.leaves({}) == [] and C.leaves({"kids": [None, 3, {"type": "h", "level": "x", "page number": "y"}]})[0]["level"] == 1


@pytest.mark.parametrize("heads,left", [([(3, "x"), (1, "y"), (2, "z")], "yz"), ([(1, "x"), (2, "y"), (2, ""), (3, "z")], "xz"), ([(2, "x"), (None, "y")], "y"), ([(1, "x"), (1, None)], ""), ([], "")])
def test_breadcrumbs(heads, left):
    assert "".join(C.breadcrumb(heads)) == left


def test_sections_over_pages():
    found = chunked(("text", "intro", 1, None), ("heading", "Alpha", 1, 1), ("text", "one", 1, None), ("_skip", "foot", 1, None), ("text", "two", 2, None), ("text", "", 2, None), ("text", "three", 2, None), ("text", "four", 3, None), ("table", "|h|", 3, None), ("text", "five", 4, None))
    assert [(c["content"], c["strategy"], c["page"]) for c in found] == [
        ("intro", "size", 1),
        ("Alpha\n\none", "size", 1),
        ("Alpha (Forts.)\n\ntwo\n\nthree", "page_continuation", 2),
        ("Alpha (Forts.)\n\nfour", "page_continuation", 3),
        ("Alpha\n\n|h|", "intact", 3),
        ("Alpha\n\nfive", "size", 4),
    ]
    assert found[0]["heading_path"] == [] and found[5]["heading_path"] == ["Alpha"]
    assert [(c["content"], c["strategy"]) for c in chunked(("text", "p", 1, None), ("text", "q", 2, None), ("image", None, 2, None), ("text", "r", 2, None))] == [("p", "size"), ("q", "page_continuation"), (None, "image"), ("r", "size")]
    assert chunked(("heading", "only", 1, 1), ("_skip", "x", 1, None)) == [] and C.sections([], [], [], []) == []


def test_sections_are_as_full_as_they_can_be():
    rng = random.Random(6)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    texts = [chr(97 + k % 26) * n for k, n in enumerate(sizes)]
    found = [c["content"].split("\n\n") for c in chunked(*(("text", t, 1, None) for t in texts), size=100) if c["strategy"] == "size"]
    whole = [c["content"] for c in chunked(*(("text", t, 1, None) for t in texts), size=10**6)]
    assert whole == ["\n\n".join(texts)]
    assert all(sum(map(len, part)) <= 100 for part in found)
    starts = C.starts_within(sizes, 100)
    for a, b in zip(starts, [*starts[1:], None], strict=True):
        assert sum(sizes[a:b]) <= 100 and (b is None or sum(sizes[a : b + 1]) > 100)
    assert C.starts_within([200, 1, 200], 100) == [0, 1, 2] and C.starts_within([], 5) == []


def test_rows_of_large_tables():
    head = "| n | square |\n| --- | --- |"
    rows = [f"| {n} | {n * n} |" for n in range(50)]
    found = C.table_parts("\n".join([head, *rows, "  "]), 200)
    assert {how for _, how in found} == {"row_groups"} and all(text.startswith(head + "\n") for text, _ in found)
    parts = [text.split("\n")[2:] for text, _ in found]
    assert sum(parts, []) == rows
    room = 200 - len(head)
    assert all(sum(map(len, p)) <= room for p in parts) and all(sum(map(len, p)) + len(q[0]) > room for p, q in zip(parts, parts[1:], strict=False))
    assert C.table_parts(head, 200) == [(head, "intact")] and C.table_parts(" \n", 200) == C.table_parts(None, 200) == []
    assert {how for _, how in C.table_parts("y" * 300, 200, 120)} == {"sentence_fallback"}
    long = chunked(("heading", "Beta", 1, 2), ("table", "\n".join([head, *rows]), 1, None), limit=200)
    assert all(c["content"].startswith("Beta\n\n" + head) for c in long) and len(long) >= len(found)


def test_queries_chunk_whole_documents(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    tables, got = {}, {}
    for r in QUERIES["table_chunks"](spark, sf_dir).collect():
        tables.setdefault((r["doc_id"], r["ord"]), []).append(r["content"])
    assert {k for k in tables} == {(i, n) for i, t in texts.items() for n in range(len(t.split("\n"))) if n % 9 == 4}
    for (i, n), parts in tables.items():
        rows = [row for part in parts for row in part.split("\n")[2:]]
        assert rows == [f"| {w} | 1 |" for w in texts[i].split("\n")[n].split(" ")]
    for r in QUERIES["layout_to_chunks"](spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in texts.items():
        lines = text.split("\n")
        images = sum(n % 9 == 7 for n in range(len(lines)))
        rows = got.get(i, [])
        assert sum(r["chunk_type"] == "image" for r in rows) == images and sorted(r["n"] for r in rows) == list(range(len(rows)))
        assert all(len(r["content"]) <= C.CHUNK for r in rows if r["chunk_type"] == "text" and r["strategy"] != "intact" and r["strategy"] != "row_groups")
        short = [n for n in range(len(lines)) if n % 9 in (1, 2, 3, 5, 6) and 0 < len(lines[n]) < 100]
        written = "\n\n".join(r["content"] for r in rows if r["content"])
        assert all(np.char.find(written, lines[n].strip()) >= 0 for n in short[:50] if not any(c in lines[n] for c in ".!?\t") and "  " not in lines[n])


def test_sentences_and_overlap():
    assert C.split_sentences("") == C.split_sentences(None) == C.split_sentences(" \n ") == []
    text = "Ann ran. Bob sat! e.g. here it stays.\n\nÄpfel?"
    assert C.split_sentences(text, 1000, 10) == ["Ann ran. Bob sat! e.g. here it stays. Äpfel?"]
    assert C.split_sentences(text, 20, 4) == ["Ann ran.", "ran. Bob sat! e.g. h", "g. here it stays.", ".", "ays. Äpfel?"]
    assert C.split_sentences("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    assert C.split_sentences("x" * 5, 2, 2) == ["xx", "xx", "xx", "xx", "x"]


def test_fit_for_embedding(spark):
    bad = "�"
    rows = spark.createDataFrame([("a b",), ("left " + bad * 80 + " right",), (bad * 120,), ("#" * 50 + "ab",), (None,), ("  ",)], "t string")
    assert [r[0] for r in rows.select(embedding_input(F.col("t"))).collect()] == ["a b", "left right", None, None, None, None]


def test_embedding_isolates_what_fails():
    def embedder(texts):
        if "bad" in texts:
            raise ValueError
        return [[3.0]] * len(texts)

    assert C.embed_all(["ok1", "bad", "ok2"], embedder) == [[3.0], None, [3.0]]
    assert C.embed_all([], embedder) == []


def test_uuid5(spark):
    names = ["doc:a.pdf", "doc:feed:https://x/ü?q=1", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(C.uuid5(F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_page_text():
    page = "<html><script>no</script><article><h1>T</h1><p>a<br>b</p></article><p>c</p>"
    assert C.html_text(page) == "T\na\nb\nc" and C.html_text(page, "article") == "T\na\nb" and C.html_text(None) == ""
    assert C.html_text("<style>x</style><p>open<b>bold<div>in</p></div>after") == "open\nbold\nin\nafter"


def test_selectors():
    page = '<nav>n</nav><div class="big story" id="m"><p>one</p><div class="ad">buy</div><img src=x><p>two</div><div class="story">three</div>rest'
    assert C.html_text(page, "div.story", (".ad",)) == "one\ntwo\n\nthree" and C.html_text(page, "#m") == "one\nbuy\ntwo"
    assert C.html_text(page, ".story.big", ("p",)) == "buy" and C.html_text(page, "section") == ""
    assert C.article_body(page, ("section", "div.story", "nav"), (), 10) == "one\nbuy\ntwo\n\nthree"
    assert C.article_body(page, ("nav",)) is None and C.article_body(None, ("nav",)) is None


def test_slices_hold_few_bytes_and_every_row():
    """However long a batch of texts is, what is parsed at a time is about so many bytes."""
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 5000 + ["", None]})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), 100_000))
    assert max(p.num_rows for p in parts) <= 101 and [x for p in parts for x in p["t"].to_pylist()] == batch["t"].to_pylist()


def test_trees_and_pages_are_read_by_slices(spark, sf_dir):
    for name in ("html_to_text", "extract_article", "table_markdown", "list_markdown", "layout_flatten"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
