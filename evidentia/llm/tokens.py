"""Byte-level BPE: splitting into pre-tokens, ids and piece counts.

Ids are those of the tokenizer's own library. Where a text holds only characters on which both
libraries split alike and no special string, the same merges are run by the faster one.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Characters on which the pattern's classes surely agree in all libraries; a text with any other
#: character is left to the tokenizer's own library.
_OTHER = re.compile("[^\x00-\x0a\x0d-\x1b -\x7e¡-ԯא-ת‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]")

_loaded: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """One tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        to_byte = {chr(c): b for b, c in _byte_letters().items()}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes([to_byte[c] for c in piece]): i for piece, i in vocabulary.items() if all(c in to_byte for c in piece) and piece not in self.special}
        self.merges = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether both libraries surely agree on the text."""
        return _OTHER.search(text) is None and not any(s in text for s in self.special)

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings, which the library takes out first, stand alone."""
        if self.plain(text):
            return self.find(text)
        out: list[str] = []
        for part in self.special_at.split(text) if self.special else [text]:
            if part in self.special:
                out.append(part)
            else:
                out += [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def ids(self, text: str) -> list[int]:
        """The ids of a text, without begin and end."""
        if self.plain(text):
            return self.merges.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit bytes."""
        return np.array(self.ids(text), "<u4").tobytes()

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        return np.fromiter((len(self.ids(p)) for p in pretokens), np.int64, len(pretokens))


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(rest)}


def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of a file, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def token_file(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
