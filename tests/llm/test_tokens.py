"""Encoders, files and packing against the libraries on whole texts."""

from __future__ import annotations

import functools
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skuflow.llm import cutting_stock, packing, pieces, token_files
from skuflow.llm.base import buffers
from skuflow.llm.vocabularies import unit_encoder, vocabulary_path

PARTS = [
    "a", "B", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", "23", "!", "...", " ", "　",
    "Σ", "é", "́", "<|endoftext|>", "中文", "🙂", "don't", "İ", "²", "×", "Öl", ",",
    "|", "word", " word", "​", "\x00",
]


def _texts(n=4000, seed=3):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name, lower, space", [
    ("byte_bpe_50k.json", False, True), ("word_bpe_49k.json", True, False),
])
def test_units_equal_whole_texts(name, lower, space):
    texts = _texts()
    path = vocabulary_path(name)
    ids, at = unit_encoder(path, lower, space).encode(*buffers(pa.array(texts)))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for i, e in enumerate(want):
        assert ids[at[i]:at[i + 1]].tolist() == e.ids, texts[i]


def test_pieces_equal_library_and_cover_the_text():
    path = vocabulary_path("piece_bpe_32k.model")
    texts = _texts(seed=4)
    ids, at, (begin, end) = pieces.piece_encoder(path).encode(*buffers(pa.array(texts)))
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    for i, w in enumerate(want):
        assert ids[at[i]:at[i + 1]].tolist() == w
        b, e = begin[at[i]:at[i + 1]], end[at[i]:at[i + 1]]
        if w:
            assert b[0] == 0 and e[-1] == len(texts[i].encode())
            assert (b[1:] == e[:-1]).all()


def test_character_map_equals_library():
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    library = sentencepiece.SentencePieceNormalizer(
        rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=True,
        escape_whitespaces=False,
    )
    spec = model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    own = pieces.Normaliser(spec.precompiled_charsmap, False, True)
    for text in _texts(1500, 5) + ["ﬁne ½ Ａ", "  a   b "]:
        new, source = own(text.encode())
        assert new.decode() == library.normalize(text)
        assert len(source) == len(new) + 1 and (np.diff(source) >= 0).all()


def test_piece_query(docs, none):
    path = vocabulary_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = pieces.encode_pieces(docs, path, with_pieces=True).collect()
    want = sorted(library.encode(r["text"] or "") for r in docs.collect())
    assert sorted(list(r["ids"]) for r in rows) == want
    assert pieces.encode_pieces(none, path).count() == 0


def test_codes_give_any_id():
    pick = np.random.default_rng(1)
    for high in (200, 300, 60_000, 5_000_000):
        ids = pick.integers(0, high, 5000)
        codes = token_files.Codes.of(ids)
        at = pick.integers(0, 5000, 300)
        assert codes.access(at).tolist() == ids[at].tolist()
        for _ in range(50):
            a, b = sorted(pick.integers(0, 5001, 2).tolist())
            assert codes.run(a, b).tolist() == ids[a:b].tolist()


def test_token_files(spark, docs, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 50)
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))

    def ids(text):
        return [*library.encode(text or "", add_special_tokens=False).ids, 2]

    rows = [(r["doc_id"], ids(r["text"])) for r in docs.collect()]
    raw = lambda x: np.array(x, "<u4").tobytes()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), np.array(r[1], "<u2").tobytes()))
    want, start = [], 0
    for key, x in rows:
        want.append((key, start, len(x), zlib.crc32(raw(x))))
        start += len(x)
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path)
    got = [tuple(r) for r in token_files.token_index(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    token_files.write_token_files(none, str(tmp_path / "none"))
    assert token_files.token_index(spark, str(tmp_path / "none")).count() == 0


def test_patterns_take_every_piece():
    pick = random.Random(2)
    histogram = {k: pick.randint(1, 300) for k in range(1, 65)}
    found = cutting_stock.patterns(histogram, 64)
    taken: dict[int, int] = {}
    for pattern, times in found:
        assert sum(k * n for k, n in pattern) <= 64 and times > 0
        for k, n in pattern:
            taken[k] = taken.get(k, 0) + n * times
    assert taken == histogram
    assert cutting_stock.patterns({}, 64) == []


def _least_bins(histogram, room):
    """The fewest sequences by trying, for the longest piece left, all that may go with it."""

    @functools.cache
    def bins(left):
        sizes = [k for k, n in enumerate(left, 1) for _ in range(n)]
        if not sizes:
            return 0
        best = len(sizes)
        longest = sizes.pop()
        for n in range(len(sizes) + 1):
            for extra in set(itertools.combinations(sizes, n)):
                if longest + sum(extra) <= room:
                    rest = list(left)
                    for k in (longest, *extra):
                        rest[k - 1] -= 1
                    best = min(best, 1 + bins(tuple(rest)))
        return best

    return bins(tuple(histogram.get(k, 0) for k in range(1, room + 1)))


def test_patterns_are_near_the_least():
    pick = random.Random(9)
    for _ in range(25):
        histogram = dict(Counter(pick.randint(1, 12) for _ in range(pick.randint(1, 9))))
        used = sum(t for _, t in cutting_stock.patterns(histogram, 12))
        least = _least_bins(histogram, 12)
        assert least <= used <= least + 1, histogram
    # No two lengths over half a sequence go together, and only two of half a one do.
    histogram = {k: 10 * k for k in range(1, 65)}
    bound = sum(n for k, n in histogram.items() if k > 32) + histogram[32] / 2
    assert bound <= sum(t for _, t in cutting_stock.patterns(histogram, 64)) <= bound + 64


def test_packing(docs, none):
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    texts = [r["text"] or "" for r in docs.collect()]
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    packed = packing.pack_documents(docs).cache()
    rows = packed.collect()
    assert sum(r["length"] for r in rows) == total
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    long = [r for r in rows if r["doc_id"] == 9]
    ids = [*library.encode(texts[[i for i, t in enumerate(texts) if t.startswith("tok0")][0]]).ids, 0]
    for r in long:
        part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids)
    assert packed.where(F.col("length") < 1).count() == 0
    assert packing.pack_documents(none).count() == 0
