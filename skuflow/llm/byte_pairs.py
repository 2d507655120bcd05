"""Operator 12: byte-level BPE ids, their places in the text, and texts from ids.

The vocabulary is a table of byte strings and their ranks. From it a tokeniser of the
``tokenizers`` library is made: every byte is written as a visible character, and the merge
that makes a token is the last one when its bytes are merged by lower ranks alone. (Until a
token has been made nothing is merged across its ends, so what stands around it cannot make
it otherwise; the library's merges are therefore the ranks' own.) The tokeniser is made once
on the driver and broadcast; its size is that of the vocabulary.

Texts are tokenised by their distinct units in Arrow batches. As every id stands for known
bytes, running sums of their lengths are byte offsets, and counting the bytes that begin a
character turns these into character offsets. An id may end within a character: it then has
the whole character's offsets, as have its neighbours that share it.

Decoding reads the visible characters back as bytes. Ids cut off within a character give
U+FFFD in ``decoded_text``, while ``decode`` itself returns the very bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; a text of any
length is encoded whole; rows that share a ``doc_id``, or are equal, are encoded each and have
no order, so there are no ties; an empty table gives no rows; other columns are ignored, so
their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from skuflow.llm.base import buffers, chunks, documents, spans, texts
from skuflow.llm.units import UnitEncoder
from skuflow.llm.vocabularies import byte_letters, vocabulary_path


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks: a line each, the bytes in base 64."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes ``token``; None if merging does not lead to it."""
    parts = [token[i:i + 1] for i in range(len(token))]
    below = ranks[token]
    while len(parts) > 2:
        joined = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:], strict=False)]
        lowest = min(joined)
        if lowest >= below:
            return None
        at = joined.index(lowest)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_of(ranks: dict[bytes, int], pattern: str) -> str:
    """Definition of a tokeniser that encodes each match of ``pattern`` by the ranks."""
    letters = byte_letters()

    def visible(token: bytes) -> str:
        return "".join(letters[b] for b in token)

    merges = [
        tuple(map(visible, made)) for token in sorted(ranks, key=ranks.get)
        if len(token) > 1 and (made := _halves(token, ranks))
    ]
    # A match that is a token of its own is never merged, so no merge is missed.
    model = models.BPE({visible(t): r for t, r in ranks.items()}, merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "removed", invert=True),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer.to_str()


class ByteDecoder:
    """Bytes of ids."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def of_letters(cls, vocabulary: dict[str, int]) -> ByteDecoder:
        """Read a vocabulary's visible characters back."""
        bytes_of = {letter: b for b, letter in byte_letters().items()}
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            tokens[number] = bytes(bytes_of[c] for c in token)
        return cls(tokens)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self._bytes[spans(self._starts[ids], self.lengths[ids])]


class ByteLevel:
    """Encoder and decoder of a tokeniser definition; one for each Python worker."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_str(definition)
        vocabulary = self._tokenizer.get_vocab()
        self._dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.decoder = ByteDecoder.of_letters(vocabulary)
        self.units = UnitEncoder(self._ids, self._dtype, marks=True)

    def _ids(self, units: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [np.array(e.ids, self._dtype).tobytes() for e in found]


@lru_cache(maxsize=2)
def byte_level(definition: str) -> ByteLevel:
    return ByteLevel(definition)


def places(
    data: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each id in its text, in bytes and in characters.

    ``lengths`` are the ids' bytes, ``at`` the offsets of each text's ids.
    """
    end = np.cumsum(lengths)
    start = end - lengths
    # Characters begun up to and including each byte, and before all of them.
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = np.repeat(offsets[:-1], np.diff(at))
    first = np.repeat(begun[offsets[:-1]], np.diff(at))
    return start - base, end - base, begun[start + 1] - 1 - first, begun[end] - first


ENCODED = (
    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, "
    "places_crc32 long"
)
_TOKENS = "ids array<int>, byte_starts array<long>, byte_ends array<long>, char_starts array<long>, char_ends array<long>"


def encode_bytes(
    docs: DataFrame, ranks: str, pattern: str | None = None, with_tokens: bool = False
) -> DataFrame:
    """Encode whole texts by the ranks in the file ``ranks`` and decode the ids again.

    ``n_split`` counts the ids that end within a character; ``places_crc32`` is the CRC-32 of
    all (start, end) in bytes and then all in characters, as little-endian 32-bit numbers.
    ``with_tokens`` adds the ids and these places as arrays.
    """
    import public_tokenizers

    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(
        tokenizer_of(read_ranks(ranks), pattern or public_tokenizers.PATTERN)
    )
    schema = ENCODED + (f", {_TOKENS}" if with_tokens else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def encode(batches):
        coder = byte_level(definition.value)
        with coder.units.task() as units:
            for batch in batches:
                for part in chunks(batch):
                    yield encoded(coder, units, part)

    def encoded(coder, units, part):
        data, offsets = buffers(part.column("text"))
        ids, at = units.encode(data, offsets)
        lengths = coder.decoder.lengths[ids]
        numbers = pa.array(ids).cast(pa.string())
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), numbers), ",")
        raw = memoryview(coder.decoder.decode(ids).tobytes())
        byte_at = np.concatenate([[0], np.cumsum(lengths)])[at]
        byte_start, byte_end, char_start, char_end = places(data, offsets, lengths, at)
        inside = np.append(data, 0)[np.cumsum(lengths)] & 0xC0 == 0x80 if len(ids) else np.zeros(0, bool)
        split = np.concatenate([[0], np.cumsum(inside)])[at]
        in_bytes = np.stack([byte_start, byte_end], 1).astype("<u4").tobytes()
        in_chars = np.stack([char_start, char_end], 1).astype("<u4").tobytes()
        bounds = list(zip((8 * at[:-1]).tolist(), (8 * at[1:]).tolist(), strict=True))
        columns = [
            part.column("doc_id"), pa.array(np.diff(at)),
            pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]),
            pa.array([
                hashlib.sha256(raw[a:b]).hexdigest()
                for a, b in zip(byte_at[:-1].tolist(), byte_at[1:].tolist(), strict=True)
            ]),
            pa.array(np.diff(split)),
            pa.array([zlib.crc32(in_chars[a:b], zlib.crc32(in_bytes[a:b])) for a, b in bounds], pa.int64()),
        ]
        if with_tokens:
            short = pa.array(at, pa.int32())
            columns.append(pa.ListArray.from_arrays(short, pa.array(ids.astype(np.int32))))
            for values in (byte_start, byte_end, char_start, char_end):
                columns.append(pa.ListArray.from_arrays(short, pa.array(values.astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs).mapInArrow(encode, schema)


def decoded_text(spark: SparkSession, ids: Column, ranks: str) -> Column:
    """Text of an array of ids, such as any run of a document's ids. Characters whose first
    or last bytes are missing become U+FFFD; null arrays give null."""
    letters = byte_letters()
    vocabulary = spark.sparkContext.broadcast({
        "".join(letters[b] for b in token): rank for token, rank in read_ranks(ranks).items()
    })
    shared: dict[str, ByteDecoder] = {}

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        if "decoder" not in shared:
            shared["decoder"] = ByteDecoder.of_letters(vocabulary.value)
        decoder = shared["decoder"]
        out = [
            None if x is None else
            decoder.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace")
            for x in values.to_pylist()
        ]
        return pa.array(out, pa.string())

    return decode(ids)


def op12_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_bytes(documents(spark, sf_dir), vocabulary_path("byte_bpe_multi_50k.tiktoken"))
