"""Tokenizer files and the pre-tokens that they define."""

from __future__ import annotations

import os
import re
import unicodedata

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Blocks that may hold code points which the two libraries' Unicode versions class differently.
_UNSURE = re.compile("[԰-῿₀-₟Ꟁ-꯿\U00010000-\U0001efff\U00020000-\U0010ffff]")
_BYTE_PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_WORD_PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
LOADED: dict[str, object] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer, once a process."""
    if path not in LOADED:
        from tokenizers import Tokenizer

        LOADED[path] = Tokenizer.from_file(path)
    return LOADED[path]


def specials(path: str) -> dict[str, int]:
    return {t.content: i for i, t in load(path).get_added_tokens_decoder().items()}


def unsure(text: str) -> bool:
    """Whether text holds code points that are unassigned here, so that only the library can split it."""
    return bool(_UNSURE.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


def byte_pieces(text: str, path: str) -> list[str]:
    """Pre-tokens of a text without special strings, for the byte-level vocabulary."""
    if unsure(text):
        return [text[a:b] for _, (a, b) in load(path).pre_tokenizer.pre_tokenize_str(text)]
    return _BYTE_PIECES.findall(text)


def word_pieces(text: str, path: str) -> list[str]:
    """Normalised words of a text without special strings, for the vocabulary with word ends."""
    if not text.isascii():
        if "Σ" in text or unsure(text):
            text = load(path).normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in load(path).pre_tokenizer.pre_tokenize_str(text)]
        text = unicodedata.normalize("NFC", text)
    return _WORD_PIECES.findall(text.lower())
