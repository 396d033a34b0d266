"""Token ids of whole texts with a public word BPE vocabulary, encoded word by word and remembered per worker."""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np

#: Words whose ids one Python worker keeps; beyond it the memory is emptied and filled again.
REMEMBERED_WORDS = 300_000
#: Texts of these characters only need no Unicode normalisation and lower-case character by character.
PLAIN = re.compile(r"[\t\n\r -~¡-įı-ſ]*")
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
#: How the vocabulary's own file cuts a text, for the characters of PLAIN (fixed value of the format).
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Ids of texts as little-endian 16-bit bytes; a piece of text between cuts is encoded once while it is remembered."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are ids of their own wherever they stand; texts with them are left to the library.
        self.special = tuple(token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values())
        spare = itertools.count(256)
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        #: The letter that stands for each byte in the vocabulary (a rule of the format: visible ones for themselves, then from 256 up).
        self.signs = [chr(b) if b in visible else chr(next(spare)) for b in range(256)]
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError(f"{path} has ids beyond 16 bits")

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        data = piece.encode()
        letters = piece if data.isascii() else "".join(map(self.signs.__getitem__, data))
        ids = self[piece] = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], dtype="<u2").tobytes()
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            lower = text.lower()
            if not any(token in lower for token in self.special):
                return b"".join(map(self.__getitem__, CUT.findall(lower)))
        return self._whole(text)


@functools.cache
def word_encoder(path: str | None) -> WordEncoder:
    """One encoder for each vocabulary file and worker."""
    return WordEncoder(path or vocabulary())
