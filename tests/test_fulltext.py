import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions.german import STOPS, stem, term
from tessella.operators import fulltext as X

#: Pairs of the stemmer's published vocabulary.
STEMS = """aufeinander aufeinand  aufeinanderbiss aufeinanderbiss  aufeinanderfolge aufeinanderfolg  aufeinanderfolgend aufeinanderfolg  aufeinanderfolgender aufeinanderfolg
aufeinanderfolgt aufeinanderfolgt  aufeinanderschlügen aufeinanderschlug  aufenthaltes aufenthalt  auferlegten auferlegt  auferstehung aufersteh  auferstünde auferstund
auffallenden auffall  auffälliges auffall  kategorie kategori  kategorischer kategor  katers kat  käthchen kathch  kathedrale kathedral  katholik kathol  katholischer kathol
kattunhalstücher kattunhalstuch  katzen katz  häuser haus  straße strass  bedürfnisse bedurfnis  freundlichkeit freundlich  möglichkeiten moglich  schönheit schonheit
bauer bau  neuen neu  es es  a a"""


def test_stems_of_the_published_vocabulary():
    pairs = [p.split() for line in STEMS.split("\n") for p in line.split("  ")]
    wrong = [(w, t, stem(w)) for w, t in pairs if stem(w) != t]
    assert not wrong


def test_stop_words():
    assert {"der", "eine", "einem", "unserer", "welchen", "selbst", "während", "daß", "sein", "ihr", "andere"} <= STOPS
    assert term("und") is None and term("häusern") == "haus"


TEXTS = [
    "Die Häuser der Stadt", "Haus und Stadt", "Stadt. Haus!", "ein Haus in der Stadt, das alte Haus", "Stadthaus", "", None, "alte Häuser", "alten Haus Stadt", "Stadt", "Haus " * 50 + "Stadt", "die alte der Stadt alte Stadt",
]


def brute(texts, asked, k, sparse):
    """All by plain lists of words, a phrase by looking at every place."""
    held = {i: [term(w) for w in re.findall(r"[^\W_]+", (t or "").lower())] for i, t in texts}
    alternatives = X.parsed(asked)
    wanted = list(dict.fromkeys(p for w, _ in alternatives for p in w))
    excluded = [p for _, e in alternatives for p in e]
    found = []
    for i, words in held.items():
        at = lambda p: [s for s in range(len(words)) if all(0 <= s + o - p.offsets[0] < len(words) and words[s + o - p.offsets[0]] == t for t, o in zip(p.terms, p.offsets, strict=True))]  # noqa: B023, E731
        full = any(all(at(p) for p in w) and not any(at(p) for p in e) for w, e in alternatives)
        some = any(at(p) for p in wanted) and not any(at(p) for p in excluded)
        if full or some:
            score = sum(1 - 1 / (1 + len(at(p))) for p in wanted)
            starts = [[s - p.offsets[0] for s in at(p)] for p in wanted]
            score += sum(1 / (1 + min(abs(x - y) for x in a for y in b)) for a, b in zip(starts, starts[1:], strict=False) if a and b)
            found.append((full, sum(bool(at(p)) for p in wanted), round(score, 6), i))
    if sum(f for f, *_ in found) >= sparse:
        found = [x for x in found if x[0]]
    best = sorted(found, key=lambda x: (-x[1], -x[2], x[3]))[:k]
    return [(i, m, s, n) for n, (_, m, s, i) in enumerate(best, 1)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(1)
    texts = [*enumerate(TEXTS), *((100 + i, " ".join(rng.choices(["Haus", "Häuser", "alte", "der", "Stadt", "neu"], k=rng.randrange(12)))) for i in range(150))]
    path = str(tmp_path_factory.mktemp("index") / "t")
    X.write_index(spark.createDataFrame(texts, "id long, text string"), path)
    return texts, spark.read.parquet(path), path


@pytest.mark.parametrize("sparse", [0, 10, 10_000])
@pytest.mark.parametrize("asked", ["haus", "Haus Stadt", '"alte Haus"', '"Stadt alte" haus -neu', '"Haus der Stadt"', "alte haus or neu -stadt", '-"der Stadt" haus', "und der", "", '"" -haus', "fehlt haus", '"haus und stadt" or "neue Häuser"', "or or haus"])
def test_search_equals_brute_force(index, asked, sparse):
    texts, table, _ = index
    got = [tuple(r) for r in X.search(table, asked, 40, sparse).orderBy("lexical_rank").collect()]
    assert got == brute(texts, asked, 40, sparse)


def test_a_search_reads_only_its_terms_lists(spark, index, tmp_path):
    plan = X.search(index[1], "haus stadt")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[haus,stadt\]\)", plan)
    rows = spark.range(0, 200_000, 1, 4).select(F.col("id"), F.concat_ws(" ", F.lit("haus"), F.concat(F.lit("w"), F.col("id"))).alias("text"))
    X.write_index(rows, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    spread = table.groupBy(F.input_file_name()).agg(F.min("term").alias("a"), F.max("term").alias("b"), F.count("*").alias("n")).collect()
    assert len(spread) > 1 and sum(r["a"] <= "haus" <= r["b"] for r in spread) < len(spread)  # the list of a frequent term is several files, but not all


def test_index_of_nothing(spark, tmp_path):
    X.write_index(spark.createDataFrame([], "id long, text string"), str(tmp_path / "t"))
    assert X.search(spark.read.schema(X.POSTINGS).parquet(str(tmp_path / "t")), "haus").count() == 0


def test_texts_are_taken_apart_once(spark, tmp_path, monkeypatch):
    """The ranges of an index are not found by taking every text apart a second time."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(0, 1000, 1, 4).select(F.col("id"), F.concat(F.lit("haus w"), F.col("id")).alias("text"))
    plain = X.postings

    def counted(texts):
        def each(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return plain(texts).mapInArrow(each, X.POSTINGS)

    monkeypatch.setattr(X, "postings", counted)
    X.write_index(rows, str(tmp_path / "t"))
    assert seen.value == spark.read.parquet(str(tmp_path / "t")).count() == 2000
