"""Find the documents that reproduce passages of held-out test items.

Method: the CGK random walk maps edit distance to Hamming distance: reading a word
sequence, it emits the current word at every step and moves on only where a random bit of
(step, word) says so, so two sequences that differ by few insertions, deletions and
changes emit equal words at most steps.  Bit-sampling LSH keys windows by the words emitted
at a few steps; several independent walks give the target recall.  Every key that a window
of a document shares with a window of an item is a hit, and hits are verified exactly: the
words around them are aligned and the errors of the best stretch counted.

Scale: the index of a bounded block of items goes to every executor.  The corpus is scanned
whole, once to count the runs of words that recur in it and once to match; only counts of
item words and matches leave a task.  No pairs of
documents are formed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import NO_BLANKS, word_numbers
from millrace.plans import packed, unpacked

#: Most words of the items whose index is sent to the executors at once; more items take several scans.
MOST_ITEM_WORDS = 2_000_000
#: Steps of a walk, sampled steps of a key and walks: passages of 25 words with three words
#: changed, added or left out share a key with their item in all of 1,500 trials.
STEPS = 22
SAMPLED = 10
WALKS = 6
#: Sampled steps after which windows are left whose words so far no item has.
_LOOKS = [2, 4]
_SEED = 20_11
#: Words on either side of a hit that support it, and how far from their place.
_AROUND, _SHIFT = 24, 3
#: Share of the least passage that must support a hit, and that must not be stock sentences.
_SUPPORT, _OWN = 0.5, 0.4
#: Words in a row by which stock sentences are told, least share of the different texts and number of surroundings.
STOCK_WORDS, STOCK_SHARE, STOCK_LEAST = 8, 0.01, 10
#: End of a sentence, but not of an abbreviation or a number.
_SENTENCE_END = re.compile(rb"[a-z\x80-\xff]{3}[.?!]+[^\s\w]{0,4}\s+")
#: Words of a stretch that must be free of errors beside the rate: the least passage of 25 words may
#: have two, one of 32 words four; sentences of one pattern agree by chance in 22 of 25 words.
_STRICT = 11
#: Share of words in error that a short stretch may have if the words that agree have so much of what its words tell.
_LOOSE, _TOLD = 0.125, 0.82
#: Words in a row that an alignment doesn't miss.
_MISSED = 12
#: Most words of a page header, and the middles of the lengths that support is looked for beyond.
_HEADER = 18
_JUMPS = tuple(range(2 * _SHIFT + 1, _HEADER + _SHIFT + 1, 2 * _SHIFT + 1))


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A number for the n words from each place on; beyond the end follow zeros."""
    h = np.zeros(len(words), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(n, dtype=np.uint32)]).astype(np.uint64)
    for k in range(n):
        h = (h ^ padded[k : k + len(words)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(24)).astype(np.uint32)


class StockCounter:
    """Counts, for every run of ``STOCK_WORDS`` words of the items, the surroundings it has in the documents."""

    def __init__(self, texts: list[str | None]) -> None:
        self.words, self.item, at = word_numbers(pa.array(texts, pa.string()))
        grams = _grams(self.words, STOCK_WORDS)
        n = len(grams)
        whole = np.zeros(n, dtype=bool)
        if n >= STOCK_WORDS:
            whole[: n - STOCK_WORDS + 1] = self.item[STOCK_WORDS - 1 :] == self.item[: n - STOCK_WORDS + 1]
        self.places = np.flatnonzero(whole)
        self.grams, self.slot = np.unique(grams[self.places], return_inverse=True)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[self.grams & np.uint32((1 << 22) - 1)] = True
        self.sentence = self._sentences(texts, at)

    def _sentences(self, texts: list[str | None], at: np.ndarray) -> np.ndarray:
        """The number of the sentence that each word belongs to."""
        new = np.zeros(len(self.words), dtype=np.int64)
        for t, text in enumerate(texts):
            mine = np.flatnonzero(self.item == t)
            if len(mine):
                new[mine[0]] = 1
                ends = [m.end() for m in _SENTENCE_END.finditer((text or "").encode())]
                first = np.searchsorted(at[mine], ends)
                new[mine[first[first < len(mine)]]] = 1
        return np.cumsum(new)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Runs found and a number for the words around each, every pair once; run -1 has a number for each text."""
        words, doc, _ = word_numbers(texts)
        n = len(words)
        if not n:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        grams = _grams(words, STOCK_WORDS)
        may = np.flatnonzero(self.seen[grams & np.uint32((1 << 22) - 1)])
        g = grams[may]
        slot = np.minimum(np.searchsorted(self.grams, g), max(0, len(self.grams) - 1))
        ok = self.grams[slot] == g if len(self.grams) else np.zeros(len(g), dtype=bool)
        ok &= doc[np.minimum(may + STOCK_WORDS - 1, n - 1)] == doc[may]
        may, slot = may[ok], slot[ok]
        # runs that follow one another have the words before the first and after the last around them
        new = np.ones(len(may), dtype=bool)
        new[1:] = (np.diff(may) != 1) | (np.diff(doc[may]) != 0)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(may))[: len(firsts)] - 1
        around = np.zeros(len(firsts), dtype=np.uint64)
        for edge, step in ((may[firsts], -1), (may[lasts] + STOCK_WORDS - 1, 1)):
            for k in range(1, STOCK_WORDS + 1):
                at = np.clip(edge + k * step, 0, n - 1)
                inside = (edge + k * step >= 0) & (edge + k * step < n) & (doc[at] == doc[edge])
                around = (around ^ np.where(inside, words[at], np.uint32(0))) * np.uint64(0x9E3779B97F4A7C15)
                around ^= around >> np.uint64(29)
        starts = np.flatnonzero(np.append(True, np.diff(doc) != 0))
        mixed = (words.astype(np.uint64) + np.uint64(1)) * (np.arange(n, dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, n))).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
        run = np.concatenate([slot.astype(np.int64), np.full(len(starts), -1)])
        where = np.concatenate([np.repeat(around, lasts - firsts + 1), whole]).view(np.int64)
        order = np.lexsort((where, run))
        run, where = run[order], where[order]
        once = np.append(True, (np.diff(run) != 0) | (np.diff(where) != 0))
        return run[once], where[once]

    def stock(self, counts: dict[int, int], documents: int) -> np.ndarray:
        """Which item words belong to a stock sentence.

        That is a stretch of runs that ``STOCK_SHARE`` of the different texts or more have, in as many
        surroundings, and that ends at one place inside the item: most texts that have it don't go
        on as the item does.  A passage that leaks often has no such end, or covers more than a sentence.
        """
        least = max(STOCK_LEAST, STOCK_SHARE * documents)
        n = np.array([counts.get(k, 0) for k in range(len(self.grams))], dtype=np.int64)[self.slot] if len(self.grams) else np.empty(0, dtype=np.int64)
        out = np.zeros(len(self.words), dtype=bool)
        if not len(n):
            return out
        same = np.diff(self.places) == 1
        same &= self.item[self.places[1:]] == self.item[self.places[:-1]]
        falls, rises = same & (n[1:] * 2 < n[:-1]), same & (n[:-1] * 2 < n[1:])
        split = ~same | falls | rises | ((n[1:] >= least) != (n[:-1] >= least))
        firsts = np.flatnonzero(np.append(True, split))
        lasts = np.append(firsts[1:], len(n)) - 1
        for f, t in zip(firsts.tolist(), lasts.tolist()):
            ends = (f > 0 and rises[f - 1]) or (t < len(n) - 1 and falls[t])
            if n[f] < least or not ends:
                continue
            words = slice(self.places[f], self.places[t] + STOCK_WORDS)
            long = np.unique(self.sentence[words], return_counts=True)[1] >= STOCK_WORDS
            if long.sum() < 2:
                out[words] = True
        return out


class ItemIndex:
    """Keys of all windows of all items, one table per walk."""

    def __init__(self, ids: list[int], texts: list[str | None], walks: int = WALKS, stock: np.ndarray | None = None) -> None:
        self.ids = np.array(ids, dtype=np.int64)
        self.words, self.item, at = word_numbers(pa.array(texts, pa.string()))
        self.rank = self._ranks(texts, at)
        n = len(self.words)
        self.own = np.ones(n, dtype=bool) if stock is None else ~stock
        # words of stock sentences are numbers that no text has, or hardly
        telling = np.where(self.own, self.words, np.arange(n, dtype=np.uint32) * np.uint32(2654435761) + np.uint32(97))
        self.bigrams = _grams(telling, 2)
        # how telling a word is: names and numbers stand in few items, the words of a pattern in many
        kinds, of = np.unique(self.words, return_inverse=True)
        first = np.unique(of.astype(np.int64) * (len(ids) + 1) + self.item)
        held = np.bincount(first // (len(ids) + 1), minlength=len(kinds))
        self.weight = np.log1p(len(ids) / held[of]) if n else np.empty(0)
        self.padded = np.concatenate([telling, np.zeros(STEPS + 1, dtype=np.uint32)])
        rng = np.random.default_rng(_SEED)
        self.odd = (rng.integers(0, 2**31, walks, dtype=np.int64) * 2 + 1).astype(np.uint32)
        # the first step is always sampled: a window starts with a word of the item
        self.steps = [np.sort(np.append(0, 1 + rng.choice(STEPS - 1, SAMPLED - 1, replace=False))) for _ in range(walks)]
        bits = max(16, int(np.ceil(np.log2(max(n, 1) * 32 + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.starts = np.zeros(1 << bits, dtype=bool)
        self.starts[self._first_words(self.padded)[:n]] = True
        self.begun = np.zeros(1 << bits, dtype=bool)
        self.tables = []
        for w in range(walks):
            keys, _ = self._keys(self.padded, np.arange(n), w, new=True)
            order = np.argsort(keys, kind="stable")
            uniq, first, count = np.unique(keys[order], return_index=True, return_counts=True)
            seen = np.zeros(1 << bits, dtype=bool)
            seen[(uniq & self.mask).astype(np.int64)] = True
            self.tables.append((seen, uniq, first, count, order))

    def _ranks(self, texts: list[str | None], at: np.ndarray) -> np.ndarray:
        """The place of each numbered word among all words of its item, those without number included."""
        out = np.zeros(len(self.words), dtype=np.int64)
        for t, text in enumerate(texts):
            mine = np.flatnonzero(self.item == t)
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            space = (raw == 32) | (raw == 10) | (raw == 13) | (raw == 9)
            new = ~space
            new[1:] &= space[:-1]
            token = np.cumsum(new)[at[mine]] - 1
            # characters of scripts without blanks are words of their own
            more = np.zeros(len(mine), dtype=np.int64)
            more[1:] = NO_BLANKS[raw[at[mine][1:]]] & (token[1:] == token[:-1])
            out[mine] = token + np.cumsum(more)
        return out

    def _first_words(self, padded: np.ndarray) -> np.ndarray:
        """Slot of the word that a window begins with, which every walk emits first."""
        h = padded.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(17)) & self.mask).astype(np.int64)

    def _keys(self, words: np.ndarray, at: np.ndarray, walk: int, new: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The words that the walk emits at its sampled steps, hashed, and the windows with such a key.

        Windows of which no item has the first words are left on the way; ``new`` ones are those of the items.
        """
        x = words * self.odd[walk]
        x ^= x >> np.uint32(15)
        here = at.copy()
        key = np.zeros(len(at), dtype=np.uint64)
        sampled = set(self.steps[walk].tolist())
        looks = set(self.steps[walk][_LOOKS].tolist())
        for t in range(int(self.steps[walk][-1]) + 1):
            emitted = x[here]
            if t in sampled:
                key = (key ^ emitted) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            if t in looks:
                slot = (key & self.mask).astype(np.int64)
                if new:
                    self.begun[slot] = True
                else:
                    may = np.flatnonzero(self.begun[slot])
                    at, here, key, emitted = at[may], here[may], key[may], emitted[may]
            here += (emitted >> np.uint32(t)) & np.uint32(1)
        return key, at

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word places (in ``words``, in the items) whose windows share a key, each pair once."""
        padded = np.concatenate([words, np.zeros(STEPS + 1, dtype=np.uint32)])
        begin = np.flatnonzero(self.starts[self._first_words(padded)[: len(words)]])
        got = []
        for w, (seen, uniq, first, count, order) in enumerate(self.tables):
            keys, at = self._keys(padded, begin, w)
            may = np.flatnonzero(seen[(keys & self.mask).astype(np.int64)])
            k = keys[may]
            slot = np.minimum(np.searchsorted(uniq, k), len(uniq) - 1)
            ok = uniq[slot] == k
            may, slot = may[ok], slot[ok]
            c = count[slot]
            spread = np.repeat(first[slot], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            got.append(np.repeat(at[may], c) * np.int64(len(self.words)) + order[spread])
        both = np.unique(np.concatenate(got)) if got else np.empty(0, dtype=np.int64)
        return both // max(1, len(self.words)), both % max(1, len(self.words))

    def verified(self, words: np.ndarray, doc: np.ndarray, least: int, rate: float) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word of the item, words of the item, errors) of the best stretch of each pair that has one.

        A stretch has at least ``least`` words of the item in a row, of which at most ``rate``
        are in error.
        """
        p, q = self.hits(words)
        if not len(p):
            return []
        # one hit for each few words of a diagonal
        _, one = np.unique(np.stack([doc[p], self.item[q], (p - q) >> 2, q >> 3]), axis=1, return_index=True)
        p, q = p[one], q[one]
        bigrams = _grams(words, 2)
        keep = self._support(bigrams, p, q) >= least * _SUPPORT
        rest = np.flatnonzero(~keep)
        for few in np.array_split(rest, len(rest) // 20_000 + 1):
            keep[few] = self._support_over_header(bigrams, p[few], q[few]) >= least * _SUPPORT
        p, q = p[keep], q[keep]
        out = []
        pair = doc[p] * np.int64(len(self.ids)) + self.item[q]
        order = np.argsort(pair, kind="stable")
        keys, firsts = np.unique(pair[order], return_index=True)
        near, held = [], 0
        for k, mine in enumerate(np.split(order, firsts[1:])[: len(keys)]):
            near.append(self._near(words, doc, p[mine], q[mine]))
            held += len(near[-1].i)
            if held >= _MATCHES or k == len(keys) - 1:
                for key, best in zip(keys[k + 1 - len(near) : k + 1].tolist(), self._align(near, least, rate)):
                    if best:
                        out.append((key // len(self.ids), key % len(self.ids), *best))
                near, held = [], 0
        return out

    def _support(self, bigrams: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Pairs of adjacent item words around a hit that the document has within a few words of their place."""
        n, m = len(bigrams), len(self.words)
        total = np.zeros(len(p), dtype=np.int16)
        for o in range(-_AROUND, _AROUND + 1):
            j = np.clip(q + o, 0, m - 1)
            want, inside = self.bigrams[j], (self.item[j] == self.item[q]) & (q + o >= 0) & (q + o < m)
            found = np.zeros(len(p), dtype=bool)
            for shift in range(-_SHIFT, _SHIFT + 1):
                found |= bigrams[np.clip(p + o + shift, 0, n - 1)] == want
            total += found & inside
        return total

    def _support_over_header(self, bigrams: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The same where on either side of a hit the document may have a page header in between."""
        n, m = len(bigrams), len(self.words)
        total = np.zeros(len(p), dtype=np.int16)
        reach = _AROUND + _JUMPS[-1] + _SHIFT
        around = [bigrams[np.clip(p + x, 0, n - 1)] for x in range(-reach, reach + 1)]
        for side in (np.arange(_AROUND + 1), -np.arange(1, _AROUND + 1)):
            straight = np.zeros(len(p), dtype=np.int16)
            jumped = [np.zeros(len(p), dtype=np.int16) for _ in _JUMPS]
            for o in side.tolist():
                j = np.clip(q + o, 0, m - 1)
                want, inside = self.bigrams[j], (self.item[j] == self.item[q]) & (q + o >= 0) & (q + o < m)
                founds = []
                for jump in (0, *_JUMPS):
                    found = np.zeros(len(p), dtype=bool)
                    for shift in range(-_SHIFT, _SHIFT + 1):
                        found |= around[reach + o + shift + (jump if o >= 0 else -jump)] == want
                    founds.append(found & inside)
                # the most so far beyond a header of each length: straight until here, or over it before
                for x, found in zip(jumped, founds[1:]):
                    np.maximum(x, straight, out=x)
                    x += found
                straight += founds[0]
            best = straight
            for x in jumped:
                best = np.maximum(best, x)
            total += best
        return total

    def _matches(self, lo: int, hi: int, words: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the item, in ``words``) of equal words within a header of one of the diagonals, in order.

        The words are taken in bands, so what is held at once doesn't grow with the document.
        """
        order = np.argsort(self.words[lo:hi], kind="stable")
        known = self.words[lo:hi][order]
        found = []
        for start in range(0, len(words), _BAND):
            band = words[start : start + _BAND]
            first, last = np.searchsorted(known, band), np.searchsorted(known, band, side="right")
            n = last - first
            j = np.repeat(np.arange(len(band)), n)
            i = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
            d = start + j - i
            at = np.searchsorted(diagonals, d)
            apart = np.minimum(np.abs(d - diagonals[np.minimum(at, len(diagonals) - 1)]), np.abs(d - diagonals[np.maximum(at - 1, 0)]))
            near = apart <= _HEADER + _SHIFT
            found.append((i[near], start + j[near]))
        i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 2
        order = np.lexsort((j, i))
        return i[order], j[order]

    def _near(self, words: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray) -> _Matches:
        """The equal words of a text and an item near a diagonal that has a hit."""
        item = self.item[q[0]]
        lo, hi = np.searchsorted(self.item, item), np.searchsorted(self.item, item, side="right")
        d0, d1 = np.searchsorted(doc, doc[p[0]]), np.searchsorted(doc, doc[p[0]], side="right")
        d0, d1 = max(d0, p.min() - (q.max() - lo) - _HEADER * 4), min(d1, p.max() + (hi - q.min()) + _HEADER * 4)
        i, j = self._matches(lo, hi, words[d0:d1], np.unique((p - d0) - (q - lo)))
        rank, weight = self.rank[lo:hi], self.weight[lo:hi]
        first, last = np.append(0, rank[:-1] + 1), np.append(rank[1:] - 1, rank[-1])
        told = np.cumsum(weight)
        # an alignment that misses twelve words in a row has ended
        reach = np.arange(len(i)) - np.searchsorted(i, i - _MISSED)
        return _Matches(i, j, reach, first[i], last[i], self.own[lo:hi][i], weight[i], np.append(0.0, told[:-1])[i], told[i])

    def _align(self, near: list[_Matches], least: int, rate: float) -> list[tuple[int, int, int] | None]:
        """For each pair the longest stretch of the item that an alignment of the two word sequences covers within the error rate.

        All pairs are worked on together, one word of each at a time.
        """
        n = np.array([len(x.i) for x in near])
        starts = np.cumsum(n) - n
        m = _Matches(*(np.concatenate(x) for x in zip(*near)))
        c = _chains(m, n, starts)
        pair = np.repeat(np.arange(len(n)), n)
        at, end = m.at, m.end  # words without a number beside a stretch belong to it
        best = np.full((4, len(n)), -1)
        # every stretch of every chain: all ends go back along their chains together
        t = np.flatnonzero(end - at[c.root] + 1 >= least)
        f = t
        while len(t):
            span, wrong = end[t] - at[f] + 1, c.errors[t] - c.errors[f]
            # what is in error: few words, or a few more if they are not just the telling ones
            few = wrong <= (span - _STRICT) * rate
            more = np.flatnonzero((wrong <= span * _LOOSE + 0.5) & ~few & (span >= least))
            if len(more):
                a, z = f[more], t[more]
                few[more] = c.told[z] - c.told[a] + m.weight[a] >= _TOLD * (m.told_to[z] - m.told_before[a])
            ok = np.flatnonzero((span >= least) & few & (c.own[t] - c.own[f] >= least * _OWN))
            if len(ok):
                # the chain of the best score that has a stretch, and of that chain the longest
                found = np.stack([c.chain[t[ok]], -span[ok], f[ok], t[ok]])
                of = pair[t[ok]]
                order = np.lexsort((*found[::-1], of))
                order = order[np.append(True, np.diff(of[order]) != 0)]
                of, found = of[order], found[:, order]
                was = best[:, of]
                less, same = was[0] < 0, np.ones(len(of), dtype=bool)
                for x, y in zip(found, was):
                    less |= same & (x < y)
                    same &= x == y
                best[:, of[less]] = found[:, less]
            more = c.back[f] >= 0
            t, f = t[more], c.back[f[more]]
        return [(int(at[f]), -length, int(c.errors[t] - c.errors[f])) if t >= 0 else None for _, length, f, t in best.T.tolist()]


class _Matches(NamedTuple):
    """Equal words of texts and items, for each pair in the order of the item and then of the text."""

    #: places in the item and in the text, and how many matches before may come before this one in an alignment
    i: np.ndarray
    j: np.ndarray
    reach: np.ndarray
    #: first and last word of the item, those without a number included, that belong to the match
    at: np.ndarray
    end: np.ndarray
    own: np.ndarray
    #: how telling the word is, and all words of the item before it and up to it
    weight: np.ndarray
    told_before: np.ndarray
    told_to: np.ndarray


class _Chains(NamedTuple):
    """The best alignment that ends at each match: the match before (-1: none) and its first, sums from that one on, the place of its chain."""

    back: np.ndarray
    root: np.ndarray
    errors: np.ndarray
    own: np.ndarray
    told: np.ndarray
    chain: np.ndarray


def _chains(m: _Matches, n: np.ndarray, starts: np.ndarray) -> _Chains:
    """The chains of pairs of ``n`` matches each: one match of every pair after the other, pairs of like size together."""
    total = len(m.i)
    out = _Chains(np.full(total, -1), np.arange(total), np.zeros(total, dtype=np.int32), m.own.astype(np.int32), m.weight.copy(), np.zeros(total, dtype=np.int64))
    some = np.flatnonzero(n)
    wide = np.zeros(len(n), dtype=np.int64)
    wide[some] = np.maximum.reduceat(m.reach, starts[some]) if len(some) else 0
    like = np.ceil(np.log2(n[some])).astype(np.int64) * 64 + np.ceil(np.log2(wide[some] + 1)).astype(np.int64)
    for kind in np.unique(like):
        mine = some[like == kind]
        mine = mine[np.argsort(-n[mine], kind="stable")]
        _chains_of_like(m, n[mine], starts[mine], out)
    return out


def _chains_of_like(m: _Matches, n: np.ndarray, starts: np.ndarray, out: _Chains) -> None:
    """The same for pairs with about as many matches, most first; a row per place, a column per pair."""
    steps = np.arange(n[0])
    inside = steps[:, None] < n
    flat = (steps[:, None] + starts)[inside]

    def table(x: np.ndarray, kind: type) -> np.ndarray:
        t = np.zeros(inside.shape, dtype=kind)
        t[inside] = x[flat]
        return t

    i, j, own, told = table(m.i, np.int32), table(m.j, np.int32), table(m.own, np.int32), table(m.weight, np.float64)
    wide = table(m.reach, np.int64).max(axis=1).tolist()
    score, errors = np.ones(i.shape, dtype=np.int32), np.zeros(i.shape, dtype=np.int32)
    back, root = np.full(i.shape, -1), np.repeat(steps[:, None], len(n), axis=1)
    active = inside.sum(axis=1).tolist()
    columns = np.arange(len(n))
    for k in range(1, len(steps)):
        a, c = k - wide[k], active[k]
        if a == k:
            continue
        di, dj = i[k, :c] - i[a:k, :c] - 1, j[k, :c] - j[a:k, :c] - 1  # words without a number can't be in error
        apart = dj - di
        # a page header in between is one addition, not as many as it has words
        cost = np.where(apart > 4, np.where(apart <= _HEADER, di + 1, 99), np.maximum(di, dj))
        cost[(di < 0) | (dj < 0)] = 99
        gain = score[a:k, :c] - cost
        gain[di >= _MISSED] = 0
        b = gain.argmax(axis=0)
        most = gain[b, columns[:c]]
        on = np.flatnonzero(most > 0)
        if len(on):
            b = b[on]
            score[k, on] = most[on] + 1
            errors[k, on] = cost[b, on] + errors[a + b, on]
            back[k, on] = b = a + b
            own[k, on] += own[b, on]
            told[k, on] += told[b, on]
            root[k, on] = root[b, on]
    # of the chains that go through a match, the one of the best score
    chain = np.empty(score.size, dtype=np.int64)
    chain[np.argsort(-score, axis=None, kind="stable")] = np.arange(score.size)
    chain = chain.reshape(score.shape)
    for k in range(len(steps) - 1, 0, -1):
        on = np.flatnonzero(back[k] >= 0)
        if len(on):
            b = back[k, on]
            chain[b, on] = np.minimum(chain[b, on], chain[k, on])
    out.back[flat] = np.where(back >= 0, back + starts, -1)[inside]
    out.root[flat] = (root + starts)[inside]
    out.errors[flat], out.own[flat], out.told[flat], out.chain[flat] = errors[inside], own[inside], told[inside], chain[inside]


#: Words of a document that are matched with an item at once, and equal words of texts and items that are aligned at once (or those of one pair).
_BAND, _MATCHES = 20_000, 200_000
#: Bytes of text that are worked on at once.
_SLICE = 4_000_000


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of at most ``_SLICE`` bytes (or one text), with the place of the first."""
    texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
    sizes = np.cumsum(np.nan_to_num(np.array(pa.compute.binary_length(texts).fill_null(0)), nan=0))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + _SLICE, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = 25,
    rate: float = 0.2,
) -> DataFrame:
    """One row per document and item of which the document reproduces at least ``least`` words in a row.

    Columns: ``item_id``, ``doc_id``, ``first_word`` (from 0, of the item), ``words`` and
    ``errors`` of the longest stretch.  ``rate`` is the share of words in error that a
    long stretch may have: one in eight that were changed on purpose, and some that damage made
    unreadable.  Short stretches may have less, as chance likeness is short: two of 25 words, four
    of 32; or one in eight plus a half, if what differs isn't mainly names and numbers, which stand in few items,
    as it is where two sentences only have their pattern in common.
    Defined cases: null, empty or blank texts and items match nothing; items without
    ``least`` words neither; null ids are kept; repeated documents each give their rows;
    items with the same text each match; an empty table on either side gives no rows.  Runs
    of words that occur in as many different surroundings as 1 % of the different texts (and at
    least ten), and that most texts end at the same place inside the item, are stock sentences: a
    stretch may hold them but must have two fifths of ``least`` besides.
    """
    spark = documents.sparkSession
    # a block of items at a time is on the driver
    listed = items.select(F.col(item_id).cast("long"), F.col(item_text)).filter(F.col(item_text).isNotNull()).toLocalIterator()
    docs = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    results = []
    for ids, texts in _blocks(listed):
        stock_counter = StockCounter(texts)
        counter = spark.sparkContext.broadcast(packed(stock_counter))

        def count(batches: Iterator[pa.RecordBatch], counter=counter) -> Iterator[pa.RecordBatch]:
            runs = unpacked(counter.value)
            for batch in batches:
                for _, part in slices(batch.column(0)):
                    run, where = runs.count(part)
                    yield pa.record_batch([pa.array(run), pa.array(where)], names=["run", "around"])

        # one number per run of words of the items, whatever the corpus
        around = docs.select("text").mapInArrow(count, "run long, around long").distinct()
        counts = around.groupBy("run").agg(F.count("around").alias("n")).toArrow()
        found = dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist()))
        stock = stock_counter.stock(found, found.get(-1, 0))
        index = spark.sparkContext.broadcast(packed(ItemIndex(ids, texts, stock=stock)))

        def match(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            items = unpacked(index.value)
            for batch in batches:
                rows = []
                for start, part in slices(batch.column(1)):
                    words, doc, _ = word_numbers(part)
                    rows += [(int(items.ids[r[1]]), start + r[0], *r[2:]) for r in items.verified(words, doc, least, rate)]
                if rows:
                    cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                    cols[1] = batch.column(0).take(cols[1])
                    yield pa.record_batch(cols, names=["item_id", "doc_id", "first_word", "words", "errors"])

        results.append(docs.select("id", "text").mapInArrow(match, "item_id long, doc_id long, first_word long, words long, errors long"))
    if not results:
        return spark.createDataFrame([], "item_id long, doc_id long, first_word long, words long, errors long")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _blocks(listed: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of bounded size, so that the index of each fits an executor."""
    ids, texts, size = [], [], 0
    for i, text in listed:
        n = len(text.split())
        if ids and size + n > MOST_ITEM_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += n
    if ids:
        yield ids, texts
