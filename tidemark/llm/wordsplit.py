"""Normalising and splitting of the word-BPE tokenizer file, as its JSON states it.

The file asks for NFC, white space folded to a blank and lower case, then splits with
one pattern and drops what lies between its matches. Both BPE operators work on these
pieces, since equal pieces always get equal ids.
"""

from __future__ import annotations

import re
import unicodedata

import regex

# Fixed values of the tokenizer file: its contractions and its two special tokens.
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9\t-\r ]+")
_ANY = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACES = re.compile(f"[{_SPACE}]+")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIALS)) + ")")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def pieces(text: str) -> list[str]:
    """The pieces of one stretch without special tokens, lower-cased."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    # Each character is lowered by itself, so a word-final capital sigma gets no final form.
    return _ANY.findall(text.replace("Σ", "σ").lower())


def split_specials(text: str) -> list[str]:
    """Stretches between special tokens at even places, special tokens at odd ones."""
    return _SPECIAL.split(text) if "<|" in text else [text]


def chunks_of(text: str) -> list[str]:
    """The stretches between white space. ``str.split`` also splits at U+001C to U+001F, which are no white space here."""
    return [c for c in _SPACES.split(text) if c] if any(map(text.__contains__, _SEPARATORS)) else text.split()
