"""Splitting of text into the units that a tokenizer merges on their own."""

from __future__ import annotations

import re
from functools import cache

#: Letters, numbers and spaces among the first 256 code points.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def byte_letters() -> tuple[str, ...]:
    """The printable letter that stands for each byte: itself if it is printable, else the next unused one from 256."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else extra))
        extra += b not in printable
    return tuple(out)


@cache
def _letter_bytes() -> dict[str, int]:
    return {ch: b for b, ch in enumerate(byte_letters())}


_WORDS = re.compile(f"{_ENDINGS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTES = re.compile(f"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def by_library(splitter, text: str) -> list[str]:
    """Units as the tokenizer's own splitter makes them; for text with letters beyond the first 256."""
    back = _letter_bytes()
    return [bytes(map(back.__getitem__, piece)).decode("utf-8") for piece, _ in splitter.pre_tokenize_str(text)]


#: Every one of the first 256 characters beside letters, digits, spaces and itself, and the endings in both cases.
PROBE = "".join(f"a{c}{c}1{c} {c}A \n{c}" for c in map(chr, range(256))) + " don't we'll I'M 'S x'd 12 ½y they're  've\n\n end  "


def own_rules_hold(pattern: re.Pattern, splitter, own: str, normal: str) -> bool:
    """Whether the short cut for Latin text splits as the tokenizer itself does; if not, the library splits everything."""
    return pattern.findall(own) == by_library(splitter, normal)


def words_like(splitter, normalise) -> bool:
    return own_rules_hold(_WORDS, splitter, PROBE.lower(), normalise(PROBE))


def bytes_like(splitter) -> bool:
    return own_rules_hold(_BYTES, splitter, PROBE, PROBE)


def words(text: str, splitter, latin: bool = True) -> list[str]:
    """Units of the word tokenizer, of text that is normalised already."""
    return _WORDS.findall(text) if latin and is_latin(text) else by_library(splitter, text)


def byte_units(text: str, splitter, latin: bool = True) -> list[str]:
    """Units of the byte-level tokenizer; together they are the text."""
    return _BYTES.findall(text) if latin and is_latin(text) else by_library(splitter, text)
