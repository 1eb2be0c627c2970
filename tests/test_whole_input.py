"""Queries against brute force over all rows of their tables, whatever their SQL reads."""

from tessella.operators.chunking import rendered
from tessella.operators.text import sanitize_messages
from tessella.registry import QUERIES
from tessella.sources.views import Views


def test_headings_of_all_documents(spark, sf_dir):
    want = set()
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for n, line in enumerate(("# " + text.replace(". ", "\n## ")).split("\n")):
            line = line.strip(" ")
            title = line.lstrip("#").strip(" ")
            if line.startswith("#") and title:
                want.add((doc_id, n, len(line) - len(line.lstrip("#")), title))
    found = [tuple(r)[:4] for r in QUERIES["markdown_toc"](spark, sf_dir).collect()]
    assert set(found) == want and len(found) == len(want)
    assert len({r[0] for r in found}) > spark.read.parquet(f"{sf_dir}/documents.parquet").count() // 2


class Chats:
    def __init__(self, rows):
        self.rows = rows

    def table(self, name):
        assert name == "conversations"
        return self.rows


def test_twelve_messages_with_their_roles(spark):
    roles = ("system", "user", "assistant", "tool")
    rows = [(1, t, roles[t % 4], f" message {t} " if t % 5 else "  ") for t in range(20)] + [(2, 0, "system", "x" * 9000)]
    want = [(c, t, "user" if r == "tool" else r, text.strip()[:8000]) for c, t, r, text in rows if text.strip()]
    want = [w for w in want if w[0] == 1][-12:] + [w for w in want if w[0] == 2]
    found = sanitize_messages(Chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    assert sorted(tuple(r) for r in found.select("conv_id", "turn", "role", "content").collect()) == want


def test_layout_trees_hold_whole_texts(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    flat, lists, tables = {}, *(dict(QUERIES[name](spark, sf_dir).collect()) for name in ("list_markdown", "table_markdown"))
    for r in rendered(Views(spark, sf_dir)).orderBy("doc_id", "ord").collect():
        flat.setdefault(r["doc_id"], []).append((r["kind"], r["content"]))
    assert set(flat) == set(lists) == set(tables) == set(texts)
    for i, text in texts.items():
        lines, words = text.split("\n"), [w.strip() for w in text.split(" ")]
        cells = [w.replace("|", r"\|").replace("\n", " ") for w in words]
        rows = [cells[k : k + 6] for k in range(0, len(cells), 6)] + [[r"a\|b", ""]]
        width = max(map(len, rows))
        rows = [row + [""] * (width - len(row)) for row in rows]
        rows.insert(1, ["---"] * width)
        assert lists[i] == "\n".join(f"- {w}" for w in words if w)
        assert tables[i] == "\n".join(f"| {' | '.join(row)} |" for row in rows)
        head, last = lines[0].strip(), [("text", x) for x in [lines[-1].strip()] if x]
        assert flat[i] == [("heading", head), *(("text", x.strip()) for x in lines if x.strip()), ("list", lists[i]), ("table", tables[i]), ("heading", head), *last, *last, ("image", None), *last, *last]
