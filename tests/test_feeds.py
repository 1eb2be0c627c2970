from tessella.operators import feeds as X

RSS = """<?xml version="1.0" encoding="iso-8859-1"?><!-- c --><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:atom="http://www.w3.org/2005/Atom">
<channel><title>Feed</title><link>http://feed/</link><atom:link href="http://feed/self" rel="self"/>
<item><title>Grün &amp; Rot</title><link> http://a/1 </link><dc:creator>Ada</dc:creator><pubDate>Mon, 01 Jan 2024</pubDate><description><![CDATA[<p>short</p>]]></description><content:encoded><![CDATA[<p>long <b>text</b></p>]]></content:encoded></item>
<item><title>No link</title><link></link></item>
<item><title>By guid</title><guid>http://a/3</guid></item>
<item><title>No permanent one</title><guid isPermaLink="false">x-4</guid></item>
<item><link>http://a/5</link><author>b@c</author></item>
</channel></rss>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel rdf:about="x"><title>F</title><link>http://f/</link></channel>
<item rdf:about="http://r/1"><title>One</title><link>http://r/1</link><dc:date>2024-02-03</dc:date><description>d</description></item></rdf:RDF>"""
ATOM = """\n<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link href="http://f/"/><author><name>Feed's own</name></author>
<entry><title type="html">&lt;i&gt;T&lt;/i&gt;</title><link rel="self" href="http://s/1"/><link rel="alternate" href="http://t/1"/><author><name>Bo</name><email>b@o</email></author><published>2024-01-02T03:04:05Z</published><updated>2024-01-03</updated><summary>s</summary>
<content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">x <b>y</b> z</div></content></entry>
<entry><title>None</title><link rel="enclosure" href="http://t/2.mp3"/></entry></feed>"""


def entries(text, encoding="utf-8"):
    return [{k: v for k, v in e.items() if v} for e in X.entries_of(text.encode(encoding))]


def test_rss():
    assert entries(RSS, "iso-8859-1") == [
        {"url": "http://a/1", "title": "Grün & Rot", "author": "Ada", "published": "Mon, 01 Jan 2024", "summary": "<p>short</p>", "content_encoded": "<p>long <b>text</b></p>"},
        {"url": "http://a/3", "title": "By guid"},
        {"url": "http://a/5", "author": "b@c"},
    ]


def test_rdf():
    assert entries(RDF) == [{"url": "http://r/1", "title": "One", "updated": "2024-02-03", "summary": "d"}]


def test_atom():
    (one,) = entries(ATOM)
    assert (one["url"], one["title"], one["author"], one["published"], one["updated"], one["summary"]) == ("http://t/1", "<i>T</i>", "Bo", "2024-01-02T03:04:05Z", "2024-01-03", "s")
    assert one["content_encoded"].startswith("x <") and "y" in one["content_encoded"] and one["content_encoded"].endswith(" z")


def test_broken_documents_and_what_is_no_feed(monkeypatch):
    for piece in (1, 7, 1 << 16):
        monkeypatch.setattr(X, "PIECE", piece)
        assert [e["url"] for e in entries(RSS.replace("iso-8859-1", "utf-8").replace("<item><title>By", "<item><title>By</b>"))] in ([], ["http://a/1"])
        assert entries("") == entries("  ") == entries("<html><item>") == entries("{}") == []
        assert len(entries(RDF)) == 1
    assert entries(RDF.replace("<rdf:RDF", '<?xml version="1.0" encoding="no-such"?><rdf:RDF', 1)) == []


def test_files(spark, tmp_path):
    for name, text in (("a.xml", RSS.replace("iso-8859-1", "utf-8")), ("b.rdf", RDF), ("c.atom", ATOM), ("d.txt", "no feed")):
        (tmp_path / name).write_text(text)
    got = {(r["path"].rsplit("/", 1)[-1], r["place"], r["url"]) for r in X.read_feeds(spark, str(tmp_path)).collect()}
    assert got == {("a.xml", 0, "http://a/1"), ("a.xml", 1, "http://a/3"), ("a.xml", 2, "http://a/5"), ("b.rdf", 0, "http://r/1"), ("c.atom", 0, "http://t/1")}
