"""Text undressing and vectorised word hashing shared by the text operators."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Container
from functools import cache

import numpy as np

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\b[^<>]*>")
_COMMENT, _COMMENT_END = "<!--", "-->"
#: Tags that stand inside a line of text: taking them away joins what they part.
INLINE_TAGS = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strong sub sup tt u var wbr".split())
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿"
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")
#: A hyphen that breaks a word at a line end, with the quote marks of the next line.
_BREAK = re.compile(r"(?<=[^\W_])[-‐‑][ \t]*\r?\n[ \t]*(?:>[ \t]*)*(?=[^\W_])")
_SOFT_BREAK = re.compile(r"­[ \t]*\r?\n[ \t]*(?:>[ \t]*)*")
WORD = re.compile(r"[^\W_]+")
#: Stands in an undressed text where a hyphen ended a line: the word goes on, or a compound's next word begins.
MARK = "\x1e"
#: Breaks of one word up to which all its readings are considered.
MOST_BREAKS = 8
_BROKEN = re.compile(rf"[^\W_]+(?:{MARK}[^\W_]+)+")


def _without_comments(text: str) -> str:
    """Comments become blanks, in one pass; an opening without an end is text."""
    out, at = [], 0
    while (start := text.find(_COMMENT, at)) >= 0 and (end := text.find(_COMMENT_END, start + len(_COMMENT))) >= 0:
        out += [text[at:start], " "]
        at = end + len(_COMMENT_END)
    return "".join([*out, text[at:]])


def undressed(text: str) -> str:
    """``text`` in lower case without markup and invisible characters; a hyphen that ends a line, with the line end, becomes ``MARK``."""
    text = text.replace(MARK, " ") if MARK in text else text
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m.group(1).lower() in INLINE_TAGS else " ", _without_comments(text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _SOFT_BREAK.sub("", text) if "\u00ad" in text else text
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    text = text.lower()
    return _BREAK.sub(MARK, text) if "-" in text or "‐" in text else text


def joined(text: str) -> str:
    """An undressed text with every broken word joined."""
    return text.replace(MARK, "")


def _forms(pieces: list[str], known: Container[str], edits: bool) -> list[str]:
    """How a broken word may read: pieces joined to words of ``known``, what lies before and after them joined to one word each.

    The joined word is a form too where it is known or words may be edited; other readings hold
    no known word, so no search for known words can tell them apart. What is broken more than
    ``MOST_BREAKS`` times is no word any more: it is read joined and apart only.
    """
    found: dict[str, None] = {}
    whole = "".join(pieces)
    if len(pieces) > MOST_BREAKS + 1:
        return [whole, " ".join(pieces)]
    if edits or whole in known:
        found[whole] = None

    def grow(words: list[str], at: int) -> None:
        if words:
            rest = "".join(pieces[at:])
            found[" ".join([*words, rest] if rest else words)] = None
        for end in range(at + 1, len(pieces) + 1):
            if (word := "".join(pieces[at:end])) in known:
                grow([*words, word], end)

    for start in range(len(pieces)):
        head = "".join(pieces[:start])
        for end in range(start + 1, len(pieces) + 1):
            if (word := "".join(pieces[start:end])) in known:
                grow([head, word] if head else [word], end)
    return list(found) or [whole]


def readings(text: str, known: Container[str], reach: int, edits: bool) -> list[str]:
    """Texts that hold every stretch of ``reach`` words in every reading of its broken words.

    Broken words that can be read in one way only are settled. Where several stand
    within ``reach`` words of each other and can be read in several ways, the stretch around
    them follows in all mixtures.
    """
    if MARK not in text:
        return [text]
    parts: list[str] = []  # text, broken word, text, broken word, ..., text
    forms: list[list[str]] = []
    at = 0
    for m in _BROKEN.finditer(text):
        options = _forms(m.group().split(MARK), known, edits)
        if len(options) == 1:
            continue
        parts.append(text[at : m.start()])
        forms.append(options)
        at = m.end()
    parts.append(text[at:])
    parts = [_BROKEN.sub(lambda m: _forms(m.group().split(MARK), known, edits)[0], p).replace(MARK, " ") for p in parts]
    if not forms:
        return parts
    choose = lambda r: "".join(x for p, f in zip(parts, [*forms, [""]], strict=True) for x in (p, f[min(r, len(f) - 1)]))
    out = {choose(r): None for r in range(max(map(len, forms)))}
    between = [len(WORD.findall(p)) for p in parts]
    done: set[tuple] = set()
    for first in range(len(forms) - 1):
        last, words = first, 0
        while last + 1 < len(forms) and (words := words + between[last + 1]) < reach:
            last += 1
        if last == first:
            continue
        head, tail = _last_words(parts[first], reach), _first_words(parts[last + 1], reach)
        stretch = (head, *parts[first + 1 : last + 1], *map(tuple, forms[first : last + 1]), tail)
        if stretch in done:  # a line that is repeated has the same mixtures
            continue
        done.add(stretch)
        for mixture in itertools.product(*forms[first : last + 1]):
            inner = "".join(x for p, f in zip([head, *parts[first + 1 : last + 1]], mixture, strict=True) for x in (p, f))
            out[inner + tail] = None
    return list(out)


def _first_words(text: str, n: int) -> str:
    for k, m in enumerate(WORD.finditer(text)):
        if k == n:
            return text[: m.start()]
    return text


def _last_words(text: str, n: int) -> str:
    found = [m.start() for m in WORD.finditer(text)]
    return text[found[-n] :] if len(found) > n else text


@cache
def word_table() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, np.uint64(base & (2**64 - 1)), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sized(n: int) -> int:
    return max(1 << 16, 1 << int(n - 1).bit_length()) if n else 1 << 16


def hash_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of ``text``, all at once.

    The hash is a prefix-sum polynomial over code points modulo 2**64, so it does
    not depend on where in the text a word stands.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(code) + 2, np.int8)
    inside[1:-1] = word_table()[code]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = _sized(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(code)], out=sums[1:])
    value = (sums[end] - sums[start]) * _powers(_INVERSE, size)[start]
    value ^= value >> np.uint64(29)
    value *= _MIX
    value ^= value >> np.uint64(32)
    return value, start, end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(_BASE) + words[k : k + count]
        out ^= out >> np.uint64(31)
        out *= _MIX
    return out
