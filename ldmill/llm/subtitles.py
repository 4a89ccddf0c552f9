"""Spoken words of subtitle files as comparable hashes.

Cue numbers, times, markup, speaker labels, sound descriptions, case, accents, punctuation and common recognition errors don't matter:
characters that get confused fold to one class, on both sides of every comparison.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd

_TIMES = re.compile(r"^[^\S\n]*﻿?(?:\d+[^\S\n]*\n[^\S\n]*)?(?:\d+:)?\d+:\d+[.,]\d+[^\S\n]*-->.*$", re.M)
_FRAMES = re.compile(r"^﻿?\{\d+\}\{\d+\}", re.M)
_HEADER = re.compile(r"\A﻿?WEBVTT.*$", re.M)
#: Longer spans between such marks count as speech, so that a mark without its partner takes no more than this; a real one that is longer breaks a passage in two.
MARKUP_CHARS, SOUND_CHARS = 80, 200
_MARKUP = re.compile(r"<[^<>\n]{0,%d}>|\{[^{}\n]{0,%d}\}" % (MARKUP_CHARS, MARKUP_CHARS))
_SOUND = re.compile(r"\*[^*\n]{1,%d}\*|\[[^\[\]]{0,%d}\]|\([^()]{0,%d}\)|[♪♫][^♪♫\n]{0,%d}[♪♫]|^[^\S\n]*[♪♫].*$" % (MARKUP_CHARS, SOUND_CHARS, SOUND_CHARS, SOUND_CHARS), re.M)
_SOUND_MARK = re.compile(r"[*\[(♪♫]")
_LABEL = re.compile(r"^([^\S\n]*[-–—]?[^\S\n]*[«“„\"]?)(?:[^\W\d_a-zà-ÿа-яёα-ω]{2,}[^\S\n]?){1,3}:(?=\s)", re.M)
#: Confusions of character recognition, and letters that fall apart into two (fixed values).
_PAIRS = [("rn", "m"), ("vv", "w"), ("œ", "oe"), ("æ", "ae")]
_CLASSES = {"|": "i", "1": "i", "l": "i", "0": "o", "e": "c", "ß": "s", "ł": "i", "ı": "i", "ø": "o", "đ": "d", "ς": "σ", "о": "o", "О": "o"}

SPACE, CUT = 1, 2
LOST = 0xFFFD


def spoken(text: str) -> str:
    """The spoken part of a subtitle file, whatever its format; plain passages stay as they are."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    t = _HEADER.sub("", t)
    if "-->" in t:
        t = _TIMES.sub("", t)
    if "}{" in t:
        # a bar is a line break here, unless it stands alone for the letter it resembles
        t = _FRAMES.sub("\n", t).replace(" | ", " l ").replace("|", "\n")
    if "<" in t or "{" in t:
        t = _MARKUP.sub("", t)
    if _SOUND_MARK.search(t):
        t = _SOUND.sub(" ", t)
    return _LABEL.sub(r"\1", t) if ":" in t else t


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> its class: 0 for what is dropped, 1 for blanks, else the code of the class's letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isspace():
            table[c] = SPACE
        elif ch.isalnum() or ch == "|":
            low = ch.lower()[:1]
            base = unicodedata.normalize("NFD", low)[:1]
            table[c] = ord(_CLASSES.get(low, _CLASSES.get(base, base)))
    table[0x3000] = SPACE
    table[0x3001:] = np.arange(0x3001, 0x110000)
    table[0xFEFF] = 0
    table[LOST] = LOST
    return table


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)


def mixed(raw: np.ndarray) -> np.ndarray:
    h = raw ^ (raw >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    raw: np.ndarray  # polynomial hash of the folded letters
    size: np.ndarray  # number of folded letters
    text: np.ndarray  # number of the text
    lost: np.ndarray  # has or had a replacement character


def words_of(texts: list[str], mask: bool = False) -> Words:
    """All words of all texts in order. A word is what stands between blanks and has a letter or digit; replacement characters at its ends don't
    count. ``mask``: as if every non-ASCII character had been lost."""
    low = "\0".join(texts).lower()
    if mask:
        low = re.sub(r"[^\x00-\x7f\s]", chr(LOST), low)
    for a, b in _PAIRS:
        low = low.replace(a, b)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    f = fold_table()[codes]
    f[codes == 0] = CUT
    f = f[f > 0]
    lost = f == LOST
    while True:
        gap = np.concatenate([[True], f <= CUT, [True]])
        edge = (f == LOST) & (gap[:-2] | gap[2:])
        if not edge.any():
            break
        lost[1:] |= edge[:-1] & ~gap[2:-1]
        lost[:-1] |= edge[1:] & ~gap[1:-2]
        f, lost = f[~edge], lost[~edge]
    gap = f <= CUT
    same = np.zeros(len(f), dtype=bool)
    same[1:] = (f[1:] == f[:-1]) & ~gap[1:] & (f[1:] != LOST)  # doubled letters count once
    lost[:-1] |= lost[1:] & same[1:]
    f, gap, lost = f[~same], gap[~same], lost[~same]
    begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(f) else np.zeros(0, dtype=np.int64)
    if not len(begin):
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty.astype(np.uint64), empty, empty, empty.astype(bool))
    text = np.cumsum(f == CUT)
    at = np.arange(len(f)) - begin[np.maximum(np.cumsum(~gap & np.concatenate([[True], gap[:-1]])) - 1, 0)]
    powers = _powers()
    value = np.where(gap, np.uint64(0), f.astype(np.uint64) * powers[at % len(powers)])
    return Words(np.add.reduceat(value, begin), np.add.reduceat((~gap).astype(np.int64), begin), text[begin], np.logical_or.reduceat(lost & ~gap, begin))


def joined(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word written together with the next of its text, and whether there is a next."""
    powers = _powers()
    step = powers[w.size % len(powers)] * np.uint64(pow(int(powers[0]), -1, 1 << 64))
    out, has = np.zeros(len(w.raw), dtype=np.uint64), np.zeros(len(w.raw), dtype=bool)
    if len(out) > 1:
        out[:-1] = w.raw[:-1] + step[:-1] * w.raw[1:]
        has[:-1] = w.text[:-1] == w.text[1:]
    return mixed(out), has


@dataclass
class Vocabulary:
    """What the words of the passages say about damaged words: whole words, words with lost characters, and pairs written as one word."""

    words: np.ndarray
    masked: np.ndarray
    unmasked: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    second: np.ndarray


WORD, MASKED, PAIR = 0, 1, 2


def vocabulary_rows(passages: list[str]) -> pd.DataFrame:
    """``kind, key, x, y``: the words of passages, what each word is once its non-ASCII characters are lost, and adjacent words written as one, all as hashes."""
    w = words_of(passages)
    h = mixed(w.raw)
    odd = [x for x in dict.fromkeys(x for p in passages for x in p.split()) if not x.isascii()]
    lost, whole = words_of(odd, mask=True), words_of(odd)
    one = [np.flatnonzero(np.bincount(v.text, minlength=len(odd)) == 1) for v in (lost, whole)]
    both = np.intersect1d(*one)
    at, to = np.searchsorted(lost.text, both), np.searchsorted(whole.text, both)
    keep = lost.lost[at] | (lost.size[at] < whole.size[to])
    at, to = at[keep], to[keep]
    j, has = joined(w)
    n = np.flatnonzero(has)
    none = lambda k: np.zeros(k, dtype=np.uint64)
    u = np.unique(h)
    parts = [(WORD, u, none(len(u)), none(len(u))), (MASKED, mixed(lost.raw)[at], mixed(whole.raw)[to], none(len(at))), (PAIR, j[n], h[n], h[n + 1])]
    return pd.concat([pd.DataFrame({"kind": k, "key": a.view(np.int64), "x": b.view(np.int64), "y": c.view(np.int64)}) for k, a, b, c in parts], ignore_index=True).drop_duplicates(["kind", "key"])


def vocabulary(rows: pd.DataFrame) -> Vocabulary:
    """From such rows, one a kind and key."""

    def part(kind: int) -> list[np.ndarray]:
        own = rows[rows["kind"] == kind]
        key, x, y = (own[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("key", "x", "y"))
        order = np.argsort(key)
        return [key[order], x[order], y[order]]

    (words, _, _), (masked, unmasked, _), (pairs, first, second) = part(WORD), part(MASKED), part(PAIR)
    return Vocabulary(words, masked, unmasked, pairs, first, second)


def among(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def mended(w: Words, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word; words that lost characters, broke in two or ran into the next come out as the words of the vocabulary they were."""
    h, text = mixed(w.raw), w.text
    bad = np.flatnonzero(w.lost)
    if len(bad):
        hit = bad[among(v.masked, h[bad])]
        h[hit] = v.unmasked[np.searchsorted(v.masked, h[hit])]
    known = among(v.words, h)
    j, has = joined(w)
    both = has & among(v.words, j)
    both[:-1] &= ~(known[:-1] & known[1:])
    both[1:] &= ~both[:-1]
    h = np.where(both, j, h)
    stay = np.ones(len(h), dtype=bool)
    stay[1:] = ~both[:-1]
    h, text, known = h[stay], text[stay], (known | both)[stay]
    split = np.flatnonzero(~known & among(v.pairs, h))
    if len(split):
        at = np.searchsorted(v.pairs, h[split])
        h[split] = v.first[at]
        h, text = np.insert(h, split + 1, v.second[at]), np.insert(text, split + 1, text[split])
    return h, text


def grams(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Running Karp-Rabin hashes of every k consecutive words of a text, and where each starts among ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    base = np.uint64(0xD6E8FEB86659FD93)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * base + h[j : j + n]
    start = np.flatnonzero(text[:n] == text[k - 1 :])
    return out[start].view(np.int64), start
