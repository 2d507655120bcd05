"""Byte-level BPE against the tiktoken library and against offsets of the tokenizers library."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skuflow.llm import byte_pairs
from skuflow.llm.vocabularies import vocabulary_path
from tests.llm.test_tokens import _texts

PATH = vocabulary_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(PATH),
        special_tokens={},
    )


def _sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_ids_equal_the_library(spark, library):
    texts = _texts(seed=6) + ["aaaaaaaaaaaaaaa" * 9, "ababababab" * 7, "🙂" * 50, "中文字" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = byte_pairs.encode_bytes(docs, PATH, with_tokens=True).collect()
    assert len(rows) == len(texts)
    whole = Tokenizer.from_str(byte_pairs.tokenizer_of(byte_pairs.read_ranks(PATH), public_tokenizers.PATTERN))
    for r in rows:
        text = texts[r["doc_id"]]
        ids = library.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids), text
        assert r["ids_sha256"] == _sha(",".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == _sha(text.encode())
        # Places by walking over the bytes of the ids.
        raw, end, spans = text.encode(), 0, []
        for token in ids:
            start, end = end, end + len(library.decode_single_token_bytes(token))
            spans.append((start, end))
        assert list(zip(r["byte_starts"], r["byte_ends"], strict=True)) == spans
        inside = [e < len(raw) and raw[e] & 0xC0 == 0x80 for _, e in spans]
        assert r["n_split"] == sum(inside)
        chars = [(len(raw[:s + 1].decode("utf-8", "ignore")) - (raw[s] < 0x80),) for s, _ in spans]
        assert len(chars) == len(ids)
        assert list(zip(r["char_starts"], r["char_ends"], strict=True)) == whole.encode(text).offsets
        flat = np.array(spans, "<u4").tobytes() + np.array(whole.encode(text).offsets, "<u4").tobytes()
        assert r["places_crc32"] == zlib.crc32(flat)


def test_ids_cut_within_a_character_decode(spark, library):
    text = "naïve 🙂🙂 中文 café"
    ids = library.encode_ordinary(text)
    runs = [ids[a:b] for a in range(len(ids)) for b in range(a, len(ids) + 1)] + [None]
    df = spark.createDataFrame([(x,) for x in runs], "ids array<int>")
    got = df.select("ids", byte_pairs.decoded_text(spark, F.col("ids"), PATH).alias("t")).collect()
    assert len(got) == len(runs) and any("�" in (r["t"] or "") for r in got)
    for r in got:
        want = None if r["ids"] is None else library.decode_bytes(r["ids"]).decode("utf-8", "replace")
        assert r["t"] == want


def test_query_on_odd_rows(spark, docs, none, library, tmp_path):
    rows = byte_pairs.encode_bytes(docs, PATH).collect()
    want = sorted(_sha(",".join(map(str, library.encode_ordinary(r["text"] or ""))).encode()) for r in docs.collect())
    assert sorted(r["ids_sha256"] for r in rows) == want
    assert byte_pairs.encode_bytes(none, PATH).count() == 0
    long = "word " * 400_000 + "x" * 300_000 + "\n" * 200_000 + "é" * 100_000
    one = spark.createDataFrame([(1, long)], "doc_id long, text string")
    one.write.parquet(str(tmp_path / "documents.parquet"))
    got = byte_pairs.op12_byte_pair_encoding(spark, str(tmp_path)).collect()
    assert [r["decoded_sha256"] for r in got] == [_sha(long.encode())]
    assert got[0]["ids_sha256"] == _sha(",".join(map(str, library.encode_ordinary(long))).encode())
