"""Alignment of two tokenisers against the libraries, group by group."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skuflow.llm import alignment
from skuflow.llm.perfect_hash import CountTable, PerfectHash
from skuflow.llm.pieces import piece_bytes
from skuflow.llm.vocabularies import byte_letters, vocabulary_path
from tests.llm.test_tokens import _texts

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


def _plain(texts):
    """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    a_library = Tokenizer.from_file(A)
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in byte_letters().items()}
    b_bytes = piece_bytes(B)
    found = []
    for text in texts:
        groups = []
        if text:
            a = a_library.encode(" " + text, add_special_tokens=False).ids
            b = b_library.encode(text)
            spell_a = [bytes(letters[c] for c in a_library.id_to_token(i)) for i in a]
            spell_b = [b_bytes[i] for i in b]
            raw = (" " + text).encode()
            if b"".join(spell_a) == raw == b"".join(spell_b):
                i = j = 0
                while i < len(a):
                    ga, gb = [a[i]], [b[j]]
                    x, y = len(spell_a[i]), len(spell_b[j])
                    i, j = i + 1, j + 1
                    while x != y:
                        if x < y:
                            ga.append(a[i])
                            x += len(spell_a[i])
                            i += 1
                        else:
                            gb.append(b[j])
                            y += len(spell_b[j])
                            j += 1
                    groups.append((ga, gb))
        found.append(groups)
    pairs = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for groups in found]
    count = Counter(p for links in pairs for p in links)
    best: dict[int, int] = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for groups, links in zip(found, pairs, strict=True):
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            sum(len(ga) for ga, _ in groups), sum(len(gb) for _, gb in groups), len(groups),
            sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        ))
    return out


_NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("table_pairs", [1_000_000, 40])
def test_equals_the_libraries(spark, monkeypatch, table_pairs):
    monkeypatch.setattr(alignment, "TABLE_PAIRS", table_pairs)
    texts = _texts(600, seed=8) + [
        "▁ marked", "<s>", "<|endoftext|>", "<0x41>", " leading", "ends ", "=" * 100, "中文字" * 30,
        "the same text", "the same text", None, "", " ", "ÿþ\x00", "\n\n\n\n",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: tuple(r[n] for n in _NAMES) for r in alignment.align_documents(docs, A, B).collect()}
    want = _plain(texts)
    assert len(got) == len(texts)
    for i, row in enumerate(want):
        assert got[i] == row, texts[i]
    assert got[texts.index("▁ marked")] == (0, 0, 0, 0, 0, 0, "")


def test_odd_rows(spark, docs, none):
    rows = alignment.align_documents(docs, A, B).collect()
    assert alignment.align_documents(docs, A, B).columns == ["doc_id", *_NAMES[:4], *_NAMES[4:]]
    want = _plain([r["text"] for r in docs.collect()])
    assert sorted(tuple(r[n] for n in _NAMES) for r in rows) == sorted(want)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert alignment.align_documents(none, A, B).count() == 0


def test_long_texts_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_HELD", 500)
    pick = random.Random(4)
    texts = ["".join(pick.choices("abcxyz01", k=30_000)), "word " * 300_000, "é" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[n] for n in _NAMES) for r in alignment.align_documents(docs, A, B).collect()}
    assert [got[i] for i in range(3)] == _plain(texts)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 31, n).astype(np.uint32))
    hashed = PerfectHash.of(keys)
    assert sorted(hashed.numbers(keys).tolist()) == list(range(len(keys))) and hashed.size == len(keys)
    stored = np.zeros(len(keys), np.uint32)
    stored[hashed.numbers(keys)] = keys
    table = CountTable([x.tobytes() for x in hashed.levels], stored, stored.astype(np.int64) + 7)
    other = np.setdiff1d(np.arange(3000, dtype=np.uint32), keys)
    assert (table.look_up(keys)[0] == keys.astype(np.int64) + 7).all()
    assert not table.look_up(other)[0].any()
