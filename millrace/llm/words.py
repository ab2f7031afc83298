"""Texts of an Arrow batch as arrays of word numbers, without a Python object per word.

A word number is a hash of the word's skeleton: ASCII consonants and digits, in lower case.
Vowels, ``c`` and everything outside ASCII are left out, so the same word has the same
number with or without accents, in decomposed form, as an HTML entity, in any wrong
encoding, and with the letters that scans confuse (``c`` for ``e``, ``1`` for ``l``,
``0`` for ``o``).  A hyphen at a line's end joins its halves.  Words whose skeleton is
empty have no number.

Words of other scripts (four letters or more, none of them ASCII, which wrong encodings of
Latin text don't make) have the number of their letters in lower case; of scripts without
blanks every character is a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

_SEPARATOR, _DROP = 0, 255
#: Bytes of several texts that are worked on at once, so that what is made of them stays in a core's cache.
_AT_ONCE = 400_000


def _classes() -> np.ndarray:
    lut = np.zeros(256, dtype=np.uint8)
    lut[128:] = _DROP
    for i, ch in enumerate("abcdefghijklmnopqrstuvwxyz"):
        code = _DROP if ch in "aeiouyc" else i + 1
        lut[ord(ch)] = lut[ord(ch.upper())] = code
    for d in "0123456789":
        lut[ord(d)] = 40 + int(d)
    lut[ord("1")] = lut[ord("l")]
    lut[ord("5")] = lut[ord("s")]
    lut[ord("0")] = _DROP
    lut[ord("'")] = _DROP
    return lut


_LUT = _classes()
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (uint32) of all texts in order, the text each belongs to, and its first byte in the text."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[texts.offset : texts.offset + n + 1]
    empty = np.empty(0, dtype=np.int64)
    if not n or offsets[-1] == offsets[0]:
        return empty.astype(np.uint32), empty, empty
    if n > 1 and offsets[-1] - offsets[0] > _AT_ONCE:
        half = min(n - 1, max(1, int(np.searchsorted(offsets, (int(offsets[0]) + int(offsets[-1])) // 2))))
        (number, text, at), (more, more_text, more_at) = word_numbers(texts.slice(0, half)), word_numbers(texts.slice(half))
        return np.append(number, more), np.append(text, more_text + half), np.append(at, more_at)
    raw = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    # texts with enough letters of another script for a word
    which = np.flatnonzero(np.bincount(np.searchsorted(offsets, np.flatnonzero(_OTHER_SCRIPT[raw]), side="right") - 1, minlength=n) >= 4)
    if len(which):
        lower = _lower(texts, which)
        if lower is not texts:
            return word_numbers(lower)
    kind = _LUT[raw]
    _join_lines(raw, kind)
    _drop_entities(raw, kind)
    apart = np.full(len(raw), -1, dtype=np.int64) if len(which) else None
    for k in which.tolist():
        mine = slice(offsets[k], offsets[k + 1])
        apart[mine] = _other_scripts(raw[mine], kind[mine])
    at = np.flatnonzero((kind != _SEPARATOR) & (kind != _DROP))
    if not len(at):
        return empty.astype(np.uint32), empty, empty
    seen = np.cumsum(kind == _SEPARATOR, dtype=np.int32)[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = seen[1:] != seen[:-1]
    firsts = np.searchsorted(at, offsets[:-1])
    new[firsts[firsts < len(at)]] = True
    if apart is not None:
        new[1:] |= (apart[at[1:]] != apart[at[:-1]])
    starts = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    h = np.add.reduceat(kind[at].astype(np.uint64) * _POWERS[place & 63], starts)
    h ^= h >> np.uint64(29)
    h *= _MIX
    text = np.searchsorted(offsets, at[starts], side="right") - 1
    return (h >> np.uint64(32)).astype(np.uint32), text, at[starts] - offsets[text]


#: First bytes of letters of other scripts in UTF-8: of alphabets (Greek, Cyrillic and on), and of scripts without blanks.
_OTHER_SCRIPT = np.zeros(256, dtype=bool)
_OTHER_SCRIPT[[*range(0xCE, 0xE2), *range(0xE3, 0xEE)]] = True
NO_BLANKS = np.zeros(256, dtype=bool)
NO_BLANKS[0xE3:0xEA] = True


def _lower(texts: pa.Array, which: np.ndarray) -> pa.Array:
    """The texts, those of ``which`` in lower case if that changes them and keeps their length."""
    mine = texts.take(pa.array(which))
    low = pa.compute.utf8_lower(mine)
    same = pa.compute.equal(pa.compute.binary_length(low), pa.compute.binary_length(mine))
    low = pa.compute.if_else(same, low, mine)
    if not len(which) or low.equals(mine):
        return texts
    mask = np.zeros(len(texts), dtype=bool)
    mask[which] = True
    return pa.compute.replace_with_mask(texts, pa.array(mask), low)


def _other_scripts(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Gives the letters of other scripts in one text their kinds; the result tells apart the characters that are words of their own."""
    first = _OTHER_SCRIPT[raw]
    after = (raw & 0xC0) == 0x80
    character = np.cumsum(~after)
    letter = np.zeros(len(raw), dtype=bool)
    at = np.flatnonzero(first)
    letter[at] = True
    for k in (1, 2):
        inside = at[(at + k < len(raw))]
        inside = inside[after[inside + k] & (character[inside + k] == character[inside])]
        letter[inside + k] = True
    single = letter & NO_BLANKS[raw[np.maximum.accumulate(np.where(~after, np.arange(len(raw)), 0))]]
    word = np.cumsum(kind == _SEPARATOR)
    lower = raw | 32
    ascii_of = np.bincount(word, ((lower >= ord("a")) & (lower <= ord("z")) | (raw >= ord("0")) & (raw <= ord("9"))) & (raw < 128), word[-1] + 1)
    letters_of = np.bincount(word, first & ~single, word[-1] + 1)
    take = single | letter & ((ascii_of == 0) & (letters_of >= 4))[word]
    kind[take] = 64 + (raw[take] & 127)
    return np.where(single, character, -1)


def _join_lines(raw: np.ndarray, kind: np.ndarray) -> None:
    hyphen = np.flatnonzero(raw[:-1] == ord("-")) if len(raw) > 1 else np.empty(0, dtype=np.int64)
    for gap in (1, 2):  # with or without a carriage return
        ok = hyphen[hyphen + gap < len(raw)]
        ok = ok[raw[ok + gap] == ord("\n")]
        if gap == 2:
            ok = ok[raw[ok + 1] == ord("\r")]
        for k in range(gap + 1):
            kind[ok + k] = _DROP


def _drop_entities(raw: np.ndarray, kind: np.ndarray) -> None:
    """``&eacute;`` and the like count as one character outside ASCII."""
    for a in np.flatnonzero(raw == ord("&")):
        tail = raw[a + 1 : a + 10]
        stop = np.flatnonzero(tail == ord(";"))
        if len(stop) and stop[0] > 1 and _is_name(tail[: stop[0]]):
            kind[a : a + 2 + stop[0]] = _DROP


def _is_name(x: np.ndarray) -> bool:
    return bool((((x | 32) >= ord("a")) & ((x | 32) <= ord("z")) | (x >= ord("0")) & (x <= ord("9")) | (x == ord("#"))).all())
