"""Ranked search against the plain formula on every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skuflow.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _plain(docs, items):
    """Result rows without item ids that are null or repeated rows' order."""
    held = [(key, _terms(text)) for key, text in docs]
    held = [(key, len(t), Counter(t)) for key, t in held if t]
    n_docs, n_terms = len(held), sum(n for _, n, _ in held)
    df = Counter(t for _, _, tf in held for t in tf)
    out = []
    for item, text in items:
        found = []
        for key, n, tf in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in set(_terms(text)) if t in tf
            )
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        found.sort()
        out += [(item, i, key, -s) for i, (s, _, _, key) in enumerate(found[:10], 1)]
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def _made_up(n=700, seed=3):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Öl", "café", "中文", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, pick.choice([" ", ", ", "-"]).join(pick.choices(words, weights, k=pick.randint(0, 80))))
            for i in range(n)]
    docs += [(n + i, docs[i % 7][1].upper()) for i in range(40)]  # copies: equal scores
    items = [(i, " ".join(pick.choices(words, k=pick.randint(0, 12)))) for i in range(60)]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_results_equal_the_formula(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search, "COORDINATES", 16)  # many terms share a coordinate
    monkeypatch.setattr(lexical_search, "RUN", 50)
    docs, items = _made_up()
    if block < 1000:
        items = items[:12]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = lexical_search.search(d, q).collect()
    assert _sorted(got) == _sorted(_plain(docs, items))


def test_bounds_spare_most_documents():
    docs, items = _made_up(3000)
    pieces, is_term, text = lexical_search.term_units(pa.array([t for _, t in docs]))
    assert pieces.filter(pa.array(is_term)).to_pylist() == [
        t.encode() for _, x in docs for t in _terms(x)
    ]
    block = lexical_search.Block.of([(i, t) for i, t in items if _terms(t)])
    place = {t.decode(): i for i, t in enumerate(block.terms)}
    rows = [sorted((place[t], n) for t, n in Counter(_terms(x)).items() if t in place) for _, x in docs]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    at = np.array([k for r in rows for k, _ in r], np.int64)
    value = np.array([100 * n + k for r in rows for k, n in r], np.int64)
    impacts = lexical_search.Impacts(offsets, at, value)
    sketch = impacts.sketches(block.coordinate)
    every = np.arange(len(docs))
    for wanted in block.wanted:
        mark = np.zeros(len(place), bool)
        mark[wanted] = True
        assert (impacts.scores(every, mark) <= sketch[block.coordinate[wanted]].sum(axis=0)).all()
    best = [lexical_search.Best() for _ in block.wanted]
    key = np.stack([np.zeros(len(docs), np.int64), every], 1)
    scored = lexical_search.search_run(impacts, key, block, best)
    assert scored < 0.2 * len(docs) * len(block.wanted)


def test_odd_rows(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "cat MAT tok5"), (1, "zweite café"), (2, None), (3, " - "), (None, "id three and"), (4, "word")]
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int")
    got = lexical_search.search(docs, q).collect()
    assert _sorted(got) == _sorted(_plain(rows, items))
    assert [c for c, _ in lexical_search.search(docs, q).dtypes] == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(none, q).count() == 0
    assert lexical_search.search(docs, q.where("false")).count() == 0


def test_long_text_and_long_lengths(spark):
    long = "alpha beta " * 500_000
    rows = [(1, long), (2, "alpha"), (3, "gamma"), (4, "beta alpha gamma")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(7, "alpha gamma")], "item_id long, text string")
    assert _sorted(lexical_search.search(d, q).collect()) == _sorted(_plain(rows, [(7, "alpha gamma")]))
    n = np.array([1, 10**9], np.int64)
    assert lexical_search._scaled_lengths(n, 10**11, 10**13).tolist() == [10, 10 + 90 * 10**20 // 10**13]
