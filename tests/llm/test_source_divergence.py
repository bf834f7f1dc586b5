"""Divergence of sources against a dense count, the sketch's bound, and the edge cases of the docstrings."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lumicube.llm import source_divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, p long, a string, v int, size int, rank int"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, top):
    """All parts by their definition, each term of each pair looked at."""
    texts, groups, df = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW)))
        texts[lang, source] += words
        groups.add((lang, source))
        df[lang].update(words.keys())
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in df.items()}
    p = {}
    for lang, source in groups:
        own = texts[lang, source]
        n, v = sum(own[t] for t in kept.get(lang, [])), len(kept.get(lang, []))
        p[lang, source] = {t: 1 + 10**9 * (own[t] + 1) // (n + v) for t in kept.get(lang, [])}
    whole = defaultdict(Counter)
    for (lang, _), c in texts.items():
        whole[lang] += c
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(b, sum((mine[t] - q[t]) ** 2 // q[t] for t in mine)) for (k, b), q in p.items() if k == lang and b != source]
        n = sum(whole[lang][t] for t in mine)
        q = {t: 1 + 10**9 * (whole[lang][t] + 1) // (n + len(mine)) for t in mine}
        terms = [(t, (mine[t] - q[t]) ** 2 // q[t]) for t in mine if texts[lang, source][t] and mine[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def table_of(spark, rows):
    return spark.createDataFrame([(k, *row, "t", 1, 2, "a", 3, 4, 5) for k, row in enumerate(rows)], SCHEMA)


def found(df):
    return sorted((x["lang"], x["source"], x["part"], x["item"], x["value"], x["rank"]) for x in df.collect())


def some_rows(r, n):
    words = [f"{a}{b}" for a in ("Ab", "é", "漢", "x", "Zz") for b in ("", "a", "ß", "B", "ab")]
    text = lambda: r.choice(["-", " ", "1", "_", "\n"]).join(r.choices(words, weights=range(1, len(words) + 1), k=r.randint(0, 30)))
    return [(r.choice([None, text(), text(), text()]), r.choice(["en", "en", "de", None, ""]), r.choice(["s0", "s0", "s1", "S2", "é", None, "s9"])) for _ in range(n)]


@pytest.mark.parametrize("least", [1, 3])
def test_divergence(spark, least):
    rows = some_rows(random.Random(7), 150) + [("alone", "fr", "x"), (None, "fr", "y"), ("big " * 300_000, "en", "s0")]
    assert found(D.divergence(table_of(spark, rows).repartition(3), least, 7)) == brute(rows, least, 7)


def test_small_sketches_and_tables_change_nothing(spark, monkeypatch):
    for name, value in (("MIN_CELLS", 16), ("MAX_CELLS", 16), ("HELD_ROWS", 10), ("SLICE", 8)):
        monkeypatch.setattr(D, name, value)
    rows = some_rows(random.Random(8), 120)
    assert found(D.divergence(table_of(spark, rows).repartition(4), 3, 200)) == brute(rows, 3, 200)


def test_sketch_never_underestimates():
    r = np.random.default_rng(3)
    sketch = np.zeros((2, 64), np.uint8)
    truth = Counter()
    for _ in range(20):
        h = np.unique(r.integers(0, 1 << 44, 30, dtype=np.uint64) % np.uint64(200))
        n = r.integers(1, 40, len(h))
        D.add(sketch, h, n)
        truth.update(dict(zip(h.tolist(), n.tolist(), strict=True)))
    h = np.array(list(truth), np.uint64)
    assert (D.estimate(sketch, h) >= np.minimum(255, [truth[x] for x in h.tolist()])).all()


def test_sketch_discards_most_rare_terms(spark, data):
    from lumicube.llm._spark import table

    docs = table(spark, data, "documents").selectExpr("lang", "source", "text")
    sketch = D.document_frequencies(docs, 1 << 16)
    rows = D.term_counts(docs, sketch, 3).groupBy("lang", "term").sum("docs").collect()
    every = D.term_counts(docs, np.full((1, 1), 255, np.uint8), 3).groupBy("lang", "term").sum("docs").collect()
    enough = [x for x in every if x[2] >= 3]
    assert {x[:2] for x in map(tuple, enough)} <= {x[:2] for x in map(tuple, rows)}
    assert len(rows) - len(enough) < 0.3 * (len(every) - len(enough))


def test_large_counts_are_exact(spark):
    n, whole = 8_999_999_999_999, 9_000_000_000_123
    row = spark.range(1).selectExpr(f"{n}L as n", f"{whole}L as whole").selectExpr(D._share("n", "whole") + " as p").first()
    assert row["p"] == 1 + 10**9 * (n + 1) // whole


def test_odd_tables(spark):
    assert D.divergence(table_of(spark, [("x", "en", "a")]).limit(0)).count() == 0
    assert found(D.divergence(table_of(spark, [("x", "en", "a"), (None, None, None)]))) == []
    assert found(D.divergence(table_of(spark, [("x", "en", "a"), ("", "en", "b")]))) == brute([("x", "en", "a"), ("", "en", "b")], 3, 200)
    assert list(D._words(pa.array([], pa.string()), pa.array([], pa.string()))) == []


def test_registered_query(spark, data, same_as_oracle):
    from lumicube.llm import queries

    assert same_as_oracle(queries.QUERIES["op12_source_divergence"](spark, data), queries.ORACLE_SQL["op12_source_divergence"]) > 0
