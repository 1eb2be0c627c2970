from html.parser import HTMLParser

import pytest

from tessella.functions import dom as D
from tessella.operators import chunking as C
from tessella.operators.text import bare_image_url


class Tree(HTMLParser):
    """A second, plain tree: nodes are lists of [tag, attributes, parent, kids]."""

    def __init__(self, text):
        super().__init__()
        self.root = self.at = ["", {}, None, []]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), self.at, []]
        self.at[3].append(node)
        if tag not in D.VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node and node[0] != tag:
            node = node[2]
        if node:
            self.at = node[2]

    def handle_data(self, data):
        self.at[3].append(data)


def walk(node):
    for kid in node[3]:
        if isinstance(kid, list):
            yield kid
            yield from walk(kid)


def strings(node, gone=()):
    for kid in node[3]:
        if isinstance(kid, str):
            if kid.strip():
                yield kid.strip()
        elif kid[0] not in D.HIDDEN and not any(kid is g for g in gone):
            yield from strings(kid, gone)


def classes(n):
    return (n[1].get("class") or "").split()


def ancestors(n):
    while n[2]:
        n = n[2]
        yield n


#: Every form of selector, and the same as a test of a node.
FORMS = {
    "p": lambda n: n[0] == "p",
    "*": lambda n: True,
    ".ad": lambda n: "ad" in classes(n),
    "div.ad": lambda n: n[0] == "div" and "ad" in classes(n),
    "article p": lambda n: n[0] == "p" and any(a[0] == "article" for a in ancestors(n)),
    "article > p": lambda n: n[0] == "p" and n[2][0] == "article",
    "body ul li > a": lambda n: n[0] == "a" and n[2][0] == "li" and any(a[0] == "ul" and any(b[0] == "body" for b in ancestors(a)) for a in ancestors(n[2])),
    "nav a, article b": lambda n: (n[0] == "a" and any(a[0] == "nav" for a in ancestors(n))) or (n[0] == "b" and any(a[0] == "article" for a in ancestors(n))),
    "a[href]": lambda n: n[0] == "a" and "href" in n[1],
    "a[href^='/t']": lambda n: n[0] == "a" and (n[1].get("href") or "").startswith("/t"),
    "html[lang=fr]>body": lambda n: n[0] == "body" and n[2][0] == "html" and n[2][1].get("lang") == "fr",
    "div div": lambda n: n[0] == "div" and any(a[0] == "div" for a in ancestors(n)),
}


def test_selectors_and_texts_of_all_pages(spark, sf_dir):
    found = dict.fromkeys(FORMS, 0)
    for (page,) in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        read, tree = D.Page(page), Tree(page or "")
        nodes = list(walk(tree.root))
        assert [e.tag for e in read.elements] == [n[0] for n in nodes]
        assert C.html_text(page) == "\n".join(strings(tree.root))
        for selector, fits in FORMS.items():
            want = [n for n in nodes if fits(n)]
            got = read.select(selector)
            assert [(e.tag, e.attrs.get("class"), read.text(e)) for e in got] == [(n[0], n[1].get("class"), "\n".join(strings(n)) if n[0] not in D.HIDDEN else "") for n in want]
            found[selector] += len(got)
        gone = [n for n in nodes if n[0] == "h1" or "ad" in classes(n)]
        parts = ["\n".join(strings(n, gone)) for n in nodes if n[0] == "article"]
        assert C.html_text(page, "article", ("h1", ".ad")) == "\n\n".join(p for p in parts if p)
    assert all(n for s, n in found.items() if s not in ("div div", "html[lang=fr]>body"))


@pytest.mark.parametrize("bad", ["", ">", "a >", "> a", "a > > b", "a:hover", "a[", "..x"])
def test_what_is_no_selector(bad):
    if bad:
        with pytest.raises(ValueError):
            D.parsed(bad)
    assert C.article_body("<article>" + "x" * 200, (bad,)) == "x" * 200


def test_default_article_is_one_list():
    page = "<main>" + "m" * 60 + "</main><article>" + "a" * 60 + "</article>"
    assert C.article_body(page, ("section",)) == "m" * 60 + "\n\n" + "a" * 60
    assert C.article_body(page, ("main, article",)) == "m" * 60 + "\n\n" + "a" * 60
    assert C.article_body(page, ("main",), least=50) == "m" * 60


def test_deep_and_odd_pages():
    deep = "<div>" * 20_000 + "end"
    assert C.html_text(deep, "div > div").count("end") == 19_999
    assert C.html_text("</p>a<br/>b") == "a\nb" and D.Page(None).elements == []


def test_images_of_a_page():
    page = """<figure><img src="https://i.example/a_w520.jpg"><img data-src="https://i.example/a_w960.jpg"></figure><img src="https://out.example/x.jpg">
    <figure><img src="/relative.jpg"><img src="" data-src="http://i.example/b.png?w=100&amp;id=1"><img src="http://i.example/b.png?id=1&amp;w=9"><img src="http://i.example/c.SVG"><img src="https://i.example/pixel/1"><img></figure>"""
    assert C.page_images(page, "figure img") == ["https://i.example/a_w960.jpg", "http://i.example/b.png?w=100&id=1"]
    assert C.page_images(page, "img") == ["https://i.example/a_w960.jpg", "https://out.example/x.jpg", "http://i.example/b.png?w=100&id=1"]
    assert C.page_images(None, "img") == []


def test_bare_image_urls():
    pairs = {
        "http://h/a_w520_r1.5_fpx29_fpy46-x.jpg#x": "http://h/a-x.jpg",
        "http://h/a.jpg?w=1&id=&q=9": "http://h/a.jpg",
        "http://h/a.jpg?b=2&a=%7e1&b=%C3%BC+x&w=3": "http://h/a.jpg?b=2&b=%C3%BC+x&a=~1",
        "http://h/a;v=1?x=%zz*": "http://h/a?x=%25zz%2A",
        "": "", "http://[bad": "http://[bad",
    }
    assert {u: bare_image_url(u) for u in pairs} == pairs
