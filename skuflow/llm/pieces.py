"""Operator 4: SentencePiece ids with the original bytes of every piece.

Texts are normalised here, by the longest prefix found in the model's compiled character
map, and each normalised byte remembers the source byte it came from. Units of the
normalised text are segmented by the library with its own normaliser switched off, and a
piece's normalised span is projected through the alignment to a span of original bytes.

Defined results: a null or empty text has no ids and decodes to the empty text; rows that
share a ``doc_id`` are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from skuflow.llm.base import buffers, chunks, documents, texts
from skuflow.llm.units import UnitEncoder
from skuflow.llm.vocabularies import vocabulary_path

_MARK = "▁"  # how the library writes a space
_BYTE_PIECE = 6  # type of the pieces that stand for one byte


class CharacterMap:
    """A model's compiled map: a double-array trie over bytes whose values are positions of
    zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self._units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self._texts = blob[4 + size:]
        self.heads = frozenset(b for b in range(256) if self._child(self._root(), b) is not None)

    @staticmethod
    def _step(unit: int) -> int:
        """Distance to a node's children."""
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _root(self) -> int:
        return self._step(self._units[0]) if self._units else 0

    def _child(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        if at < len(self._units) and self._units[at] & 0x800000FF == byte:
            return at
        return None

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that the text has at ``start``, and its replacement."""
        base, found = self._root(), None
        for end in range(start, len(text)):
            at = self._child(base, text[end])
            if at is None:
                break
            unit = self._units[at]
            base = at ^ self._step(unit)
            if unit >> 8 & 1:
                value = self._units[base] & 0x7FFFFFFF
                stop = self._texts.index(b"\0", value)
                found = end + 1 - start, self._texts[value:stop]
        return found


class Normaliser:
    """Character map and white-space rules of a model; spaces stay one byte here."""

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool):
        self._map = CharacterMap(blob) if blob else None
        self._prefix, self._squeeze = dummy_prefix, squeeze

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Replaced text, and the source byte of each of its bytes and of its end."""
        if self._map is None:
            return text, np.arange(len(text) + 1)
        out, at, i = bytearray(), [], 0
        while i < len(text):
            found = self._map.longest(text, i) if text[i] in self._map.heads else None
            if found:
                n, new = found
            else:
                n = 1
                while i + n < len(text) and text[i + n] & 0xC0 == 0x80:
                    n += 1
                new = text[i:i + n]
            out += new
            at += [i] * len(new) if found else range(i, i + n)
            i += n
        return bytes(out), np.array([*at, len(text)], np.int64)

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        new, at = self._mapped(text)
        if self._squeeze:
            data = np.frombuffer(new, np.uint8)
            space = data == 0x20
            keep = ~space
            keep[1:] |= space[1:] & ~space[:-1]
            words = np.flatnonzero(~space)
            keep[: words[0] if len(words) else len(data)] = False
            keep[words[-1] + 1 if len(words) else 0:] = False
            new, at = data[keep].tobytes(), np.append(at[:-1][keep], at[-1])
        if self._prefix and new:
            new, at = b" " + new, np.concatenate([at[:1], at])
        return new, at

    def batch(self, data: np.ndarray, offsets: np.ndarray):
        """Normalised texts of a batch: bytes, offsets, source byte of each byte and end."""
        if self._map is None and not self._squeeze:
            filled = np.diff(offsets) > 0 if self._prefix else np.zeros(len(offsets) - 1, bool)
            more = np.concatenate([[0], np.cumsum(filled)])
            new_offsets = offsets + more
            out = np.full(new_offsets[-1], 0x20, np.uint8)
            place = np.ones(len(out), bool)
            place[new_offsets[:-1][filled]] = False
            out[place] = data
            return out, new_offsets, None
        raw = data.tobytes()
        parts = [self(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        new_offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in parts])]).astype(np.int64)
        out = np.frombuffer(b"".join(p for p, _ in parts), np.uint8)
        return out, new_offsets, [at for _, at in parts]


def piece_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a model stands for: its piece, or the byte it names."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    with open(path, "rb") as f:
        pieces = model_pb2.ModelProto.FromString(f.read()).pieces
    return [
        bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE_PIECE else p.piece.replace(_MARK, " ").encode()
        for p in pieces
    ]


class PieceEncoder:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = model_pb2.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        self.normalise = Normaliser(
            spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces
        )
        pieces = [p.piece for p in model.pieces]
        self._bytes = np.array([
            1 if p.type == _BYTE_PIECE else len(p.piece.replace(_MARK, " ").encode())
            for p in model.pieces
        ])
        self._unknown = model.trainer_spec.unk_id
        spec.name = "identity"
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self._plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # Cutting before a space is right when no piece has one after another character.
        self.cuts_before_spaces = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self._dtype = "<u2" if len(pieces) <= 1 << 16 else "<u4"
        self.units = UnitEncoder(self._ids, self._dtype)

    def _ids(self, units: list[str]) -> list[bytes]:
        found = self._plain.encode(units, num_threads=1)
        kind = "H" if self._dtype == "<u2" else "I"
        return [array(kind, ids).tobytes() for ids in found]

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Ids of all texts, offsets of each text's ids, and the source span of each id,
        counted from the start of its text."""
        text, ends, sources = self.normalise.batch(data, offsets)
        if self.cuts_before_spaces:
            ids, at = self.units.encode(text, ends)
        else:
            raw = text.tobytes()
            whole = [raw[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            parts = self._ids(whole)
            ids = np.frombuffer(b"".join(parts), self._dtype)
            size = np.dtype(self._dtype).itemsize
            at = np.concatenate([[0], np.cumsum([len(p) // size for p in parts])]).astype(np.int64)
        width = self._bytes[ids]
        counts = np.diff(at)
        if (ids == self._unknown).any():  # an unknown piece covers what the others leave
            return ids, at, self._library_spans(text, ends)
        stop = np.cumsum(width)
        begin = stop - width
        base = np.repeat(ends[:-1], counts)
        begin, stop = begin - base, stop - base
        if sources is None:
            moved = np.repeat(np.diff(ends) - np.diff(offsets), counts)  # the prefix
            return ids, at, (np.maximum(begin - moved, 0), stop - moved)
        if not sources:
            return ids, at, (begin, stop)
        flat = np.concatenate(sources)
        first = np.concatenate([[0], np.cumsum([len(s) for s in sources])])[:-1]
        shift = np.repeat(first, counts)
        return ids, at, (flat[begin + shift], flat[stop + shift])

    def _library_spans(self, text: np.ndarray, ends: np.ndarray):
        """Spans from the surfaces that the library reports, for models without bytes."""
        raw, begin, stop = text.tobytes(), [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            at = 0
            for piece in self._plain.encode(raw[a:b].decode(), out_type="immutable_proto").pieces:
                n = len(piece.surface.encode())
                begin.append(at)
                stop.append(at + n)
                at += n
        return np.array(begin, np.int64), np.array(stop, np.int64)


@cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


ENCODED = (
    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_pieces(docs: DataFrame, model: str, with_pieces: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again with the library.

    ``with_pieces`` adds ``ids`` and the original byte ``spans`` (start and end of each id).
    ``spans_crc32`` is the CRC-32 of all (start, end) as little-endian 32-bit numbers.
    """
    schema = ENCODED + (", ids array<int>, starts array<long>, ends array<long>" if with_pieces else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def encode(batches):
        encoder = piece_encoder(model)
        with encoder.units.task():
            yield from encode_with(encoder, batches)

    def encode_with(encoder, batches):
        for batch in batches:
            for part in chunks(batch):
                ids, at, (begin, stop) = encoder.encode(*buffers(part.column("text")))
                bounds = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                offsets = pa.array(at, pa.int64())
                written = pa.LargeListArray.from_arrays(offsets, pa.array(ids).cast(pa.string()))
                joined = pc.binary_join(written, ",").to_pylist()
                listed = ids.tolist()
                decoded = encoder.library.decode([listed[a:b] for a, b in bounds]) if bounds else []
                spans = np.stack([begin, stop], 1).astype("<u4").tobytes()
                columns = [
                    part.column("doc_id"), pa.array(np.diff(at)),
                    pa.array([_sha(x) for x in joined]), pa.array([_sha(x) for x in decoded]),
                    pa.array([zlib.crc32(spans[8 * a:8 * b]) for a, b in bounds], pa.int64()),
                ]
                if with_pieces:
                    for values, kind in ((ids, pa.int32()), (begin, pa.int64()), (stop, pa.int64())):
                        columns.append(pa.ListArray.from_arrays(
                            offsets.cast(pa.int32()), pa.array(values.astype(np.int64)).cast(kind)
                        ))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs).mapInArrow(encode, schema)


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))
