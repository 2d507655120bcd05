"""Public tokenisers, loaded once per Python worker; their files are parameters."""

from __future__ import annotations

import os
from array import array
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from skuflow.llm.units import UnitEncoder


def vocabulary_path(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[int, str]:
    """The visible characters that byte-level vocabularies write bytes as: printable
    Latin-1 stands for itself, the other bytes for U+0100 onwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _WordTokenizer:
    """Ids of units by a ``tokenizers`` file.

    A unit that is one word of plain letters passes the normaliser and the splitter as a
    whole, so it goes to the model at once; any other unit takes the full way.
    """

    def __init__(self, path: str, lower: bool, leading_space: bool, special_as_text: bool):
        self._full = Tokenizer.from_file(path)
        self._full.encode_special_tokens = special_as_text
        self._model = self._full.model
        self._lower, self._space = lower, leading_space
        self._letters = byte_letters()
        plain = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
        self._plain = frozenset(chr(c) for c in plain if c not in (0xD7, 0xF7))

    def __call__(self, units: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        tokenize, plain = self._model.tokenize, self._plain.issuperset
        rest = []
        for i, unit in enumerate(units):
            word = unit[1:] if unit[:1] == " " else unit
            if not word or not plain(word):
                rest.append(i)
                out.append(None)
                continue
            text = unit if self._space else word
            if self._lower:
                text = text.lower()
            if not text.isascii() or text[0] == " ":
                text = text.encode().decode("latin-1").translate(self._letters)
            out.append(array("H", [t.id for t in tokenize(text)]).tobytes())
        if rest:
            found = self._full.encode_batch_fast(
                [units[i] for i in rest], add_special_tokens=False
            )
            for i, e in zip(rest, found, strict=True):
                out[i] = np.array(e.ids, "<u2").tobytes()
        return out


def vocabulary_of(path: str) -> dict[str, int]:
    """Entries of a ``tokenizers`` file as they are written there, without special tokens."""
    return Tokenizer.from_file(path).get_vocab(with_added_tokens=False)


@cache
def unit_encoder(
    path: str, lower: bool, leading_space: bool, special_as_text: bool = False
) -> UnitEncoder:
    """Encoder for a ``tokenizers`` file of at most 65,536 ids.

    ``lower``: its normaliser lower-cases; ``leading_space``: words carry the space before;
    ``special_as_text``: strings of special tokens are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if Tokenizer.from_file(path).get_vocab_size() > 1 << 16:
        raise ValueError("ids of two bytes only")
    return UnitEncoder(_WordTokenizer(path, lower, leading_space, special_as_text), marks=True)
