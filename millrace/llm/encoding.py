"""Find text that was decoded with the wrong encoding and restore it.

Method: a wrong code page is a substitution cipher over the bytes of a text.  A *unit* is
what one original character has become: one character, or several where UTF-8 was read as
a single-byte code page, once or repeatedly.  The corpus gives the counts of documents with
(character before, unit, character after).  The model says how they came about: an original
is drawn by its frequency and its bigrams with the two neighbours, then stays as it is or
goes through a *swap*.  Swaps are all pairs of an encoding and a page to read it with that
the running Python knows (none is singled out), and one unknown swap, whose table from
units to originals is learnt with the rest.  Expectation-maximization learns the share of
every swap, the table of the unknown one, the frequencies and the bigrams; a second run per
source, with the corpus as prior, learns the shares and the table of each source.

A unit is wrong if an original behind a swap is likelier than the unit itself, rightly
used; a character of another script or a sign in no alphabet has a likelihood of its own,
by its kind and its neighbours.  What the swaps of a document are is then judged by all its
wrong units together, and the mapping is applied with ``translate`` and replacement.

Scale: the corpus is read once for the counts, combined per task, and once to apply the
mapping.  To the driver go counts over all sources, bounded by the alphabets and the pages,
and a few rows per source, a bounded number of sources at a time.
"""

from __future__ import annotations

import encodings.aliases
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import durable, packed, unpacked

#: Letters and typographic characters in use in the languages of Latin script (public alphabets).
LETTERS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßąćęłńóśźżčďěňřšťůžőűăâîșțşğıđ"
SYMBOLS = "’‘“”„‚«»‹›–—…•·§¶©®™°ºª±×÷¿¡€£¥¢µ¹²³¼½¾†‡‰¬¦¨´¸¯‐‑█\u00a0\u202f\u00ad\u2009"
#: A text may have gone through the same swap of UTF-8 so often.
DEPTH = 3
LOST = "\ufffd"
#: A unit that may be itself counts as wrong if that is so many times likelier.
ODDS = 1000.0
#: Least posterior probability of an original that is put into the text.
SURE = 0.8
#: Shares before anything is learnt: of all swaps of UTF-8, of all others, of the unknown one; and the weight of these, in occurrences.
_START = (0.01, 0.003, 0.0005)
_PRIOR = 500.0
#: Weight of the corpus, in occurrences, where a source is learnt.
_CORPUS = 200.0
#: Units that the unknown swap might make of a character, and characters of a kind in no alphabet here.
_POSSIBLE = 10_000.0
#: Occurrences that the unknown swap is expected to have of each original before any is seen.
_UNSEEN = 20.0
_SMOOTH = 50.0
_ROUNDS = 12
#: Counts held by a task before it passes them on.
_HELD = 300_000
#: Sources whose shares and tables are sent to the executors at once; more sources take several scans.
MOST_SOURCES = 5_000


def decode(raw: bytes, encoding: str) -> str:
    """Bytes that a code page leaves undefined become the control characters of that number, as in common readers."""
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return "".join(_one(b, encoding) for b in raw)


def _one(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def code_pages() -> dict[str, str]:
    """Every single-byte encoding of this Python whose lower half is ASCII: its name and the characters of its upper half."""
    pages: dict[str, str] = {}
    for name in sorted(set(encodings.aliases.aliases.values())):
        try:
            if bytes(range(128)).decode(name) != "".join(map(chr, range(128))):
                continue
            upper = [_one(b, name) for b in range(128, 256)]
            defined = bytes(b for b in range(128, 256) if _defined(b, name))
            if len(defined) >= 80 and all(len(c) == 1 for c in upper) and defined.decode(name) == "".join(upper[b - 128] for b in defined):
                pages.setdefault("".join(upper), name)
        except (LookupError, UnicodeError, TypeError, AttributeError, ValueError):
            continue
    return {name: upper for upper, name in pages.items()}


def _defined(b: int, name: str) -> bool:
    try:
        return len(bytes([b]).decode(name)) == 1
    except UnicodeDecodeError:
        return False


def in_use() -> list[str]:
    letters = dict.fromkeys(LETTERS + LETTERS.upper().replace("SS", ""))
    return sorted({c for c in [*letters, *SYMBOLS] if len(c) == 1 and ord(c) > 127})


class Cipher:
    """What each unit may stand for by each swap.

    ``originals[unit]`` is a list of (original, number of the swap); ``swaps`` names them.
    """

    def __init__(self, pages: dict[str, str] | None = None) -> None:
        pages = code_pages() if pages is None else pages
        self.clean = in_use()
        self.swaps: list[tuple[str, str, int]] = []
        self.originals: dict[str, list[tuple[str, int]]] = {}
        known: set[tuple] = set()
        for wrong in pages:
            texts = {c: c for c in self.clean}
            for depth in range(1, DEPTH + 1):
                texts = {c: decode(t.encode(), wrong) for c, t in texts.items()}
                self._add(("utf-8", wrong, depth), texts, known)
        for true, upper in pages.items():
            at = {c: k for k, c in enumerate(upper) if c in set(self.clean)}
            for wrong, read in pages.items():
                if wrong != true:
                    self._add((true, wrong, 1), {c: read[k] for c, k in at.items() if read[k] != c}, known)

    def _add(self, name: tuple[str, str, int], texts: dict[str, str], known: set[tuple]) -> None:
        same = tuple(sorted(texts.items()))
        if same and same not in known:
            known.add(same)
            for c, t in texts.items():
                if any(ord(x) > 127 for x in t):
                    self.originals.setdefault(t, []).append((c, len(self.swaps)))
            self.swaps.append(name)


class Cutter:
    """Cuts a run of characters outside ASCII into units, the longest known one first.

    ``free``: a short run that isn't known at all and isn't in use is one unit, for the unknown swap.
    """

    def __init__(self, several: set[str], clean: set[str], free: bool) -> None:
        self.several, self.clean, self.free = several, clean, free
        self.longest = max(map(len, several), default=1)
        self.heads = {u[0] for u in several}
        self.memo: dict[str, list[str]] = {}

    def units(self, run: str) -> list[str]:
        if len(run) == 1:
            return [run]
        got = self.memo.get(run)
        if got is None:
            got, k = [], 0
            while k < len(run):
                n = 1
                if run[k] in self.heads:
                    n = next((m for m in range(min(self.longest, len(run) - k), 1, -1) if run[k : k + m] in self.several), 1)
                got.append(run[k : k + n])
                k += n
            if self.free and len(run) <= 3 and len(got) == len(run) and not all(c in self.clean or c == LOST or unicodedata.combining(c) for c in run):
                got = [run]
            if len(self.memo) < 100_000:
                self.memo[run] = got
        return got


_RUN = re.compile(r"[^\x00-\x7f]+")
_NEAR = {c: c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "0" for c in "0123456789"} | {c: " " for c in " \t\r\n"}
_OTHER, _FOREIGN = ".", "~"
_PLACES = [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0", " ", _OTHER, _FOREIGN]
_PLACE = {c: k for k, c in enumerate(_PLACES)}
_LATIN = np.array([c.isalpha() for c in _PLACES])


def occurrences(text: str, cutter: Cutter) -> Iterator[tuple[str, str, str, int]]:
    """(before, unit, after, place) of every unit; at the ends of the text stands a blank."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        before = _NEAR.get(text[a - 1], _OTHER) if a else " "
        after = _NEAR.get(text[b], _OTHER) if b < len(text) else " "
        units = cutter.units(m.group())
        for k, u in enumerate(units):
            yield before if k == 0 else _FOREIGN, u, after if k == len(units) - 1 else _FOREIGN, a
            a += len(u)


def places(text: str) -> list[tuple[str, str, str]]:
    """The runs of characters outside ASCII with the characters on both sides (empty at the ends), repeats included."""
    out = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        out.append((text[a - 1 : a], text[a:b], text[b : b + 1]))
    return out


def _class(c: str) -> str:
    if c.isalpha() and c not in "ªº":
        return "upper" if c.isupper() else "lower"
    return c if c in "’" else {"Pi": "open", "Ps": "open", "Pf": "close", "Pe": "close", "Zs": "space", "Mn": "mark"}.get(unicodedata.category(c), "symbol")


def _foreign_kind(c: str) -> int:
    """1 for a letter, 0 for a sign; decides how likely a character in no alphabet is between its neighbours."""
    return int(c.isalpha())


#: Neighbours of a foreign sign and of a foreign letter: another character outside ASCII, a blank, a sign, a digit, a Latin letter.
def _foreign_neighbours() -> np.ndarray:
    out = np.zeros((2, len(_PLACES)))
    for kind, (same, blank, sign, digit, latin) in enumerate(((0.2, 0.5, 0.15, 0.1, 0.05), (0.6, 0.25, 0.1, 0.0498, 0.0002))):
        out[kind, _PLACE[_FOREIGN]], out[kind, _PLACE[" "]], out[kind, _PLACE[_OTHER]], out[kind, _PLACE["0"]] = same, blank, sign, digit
        out[kind, _LATIN] = latin / _LATIN.sum()
    return np.log(out)


_FOREIGN_NEAR = _foreign_neighbours()
#: Share of characters in no alphabet here among all, by kind, each of them one of many.
_FOREIGN_RATE = np.log(np.array([1e-4, 1e-3]) / (_POSSIBLE / 10))


class Model:
    """Frequencies and bigrams of the characters in use, shares of the swaps and table of the unknown one."""

    def __init__(self, cipher: Cipher, counts: pd.DataFrame) -> None:
        self.cipher = cipher
        unit = counts["unit"].to_numpy(dtype=object)
        marks = {u for u in counts["unit"].unique() if len(u) == 1 and unicodedata.combining(u)}
        self.names = sorted(set(cipher.clean) | marks)
        self.number = {c: k for k, c in enumerate(self.names)}
        classes = [_class(c) for c in self.names]
        kinds = sorted(set(classes))
        self.kind = np.array([kinds.index(k) for k in classes])
        own = np.array([self.number.get(u, -1) for u in unit], dtype=np.int64)
        p, n = counts["p"].map(_PLACE).to_numpy(), counts["n"].map(_PLACE).to_numpy()
        c = counts["count"].to_numpy(dtype="float64")
        got = own >= 0
        self.total = np.bincount(own[got], c[got], len(self.names))
        self.raw = []
        for at in (p, n):
            table = np.zeros((len(self.names), len(_PLACES)))
            np.add.at(table, (own[got], at[got]), c[got])
            self.raw.append(table)
        # start: only lower case letters and the commonest characters are taken as themselves
        sure = np.array([k == "lower" for k in classes]) | (self.total >= np.sort(self.total)[-min(12, len(self.total))])
        self._fit(own, p, n, np.where(got & sure[np.maximum(own, 0)], c, 0.0))
        utf8 = np.array([t == "utf-8" for t, _, _ in cipher.swaps], dtype=bool)
        self.share0 = np.where(utf8, _START[0] / max(1, utf8.sum()), _START[1] / max(1, (~utf8).sum()))
        self.share, self.free = self.share0.copy(), _START[2]
        self.table: dict[str, np.ndarray] = {}
        self.explained: set[str] = set()
        e = Expectation(self, unit, p, n, c)
        for k in range(_ROUNDS):
            if k < _ROUNDS // 3:  # first without the unknown swap
                e.free = 0.0
            elif k == _ROUNDS // 3:
                # what the public swaps make of a unit isn't asked of the unknown one
                self.explained = {str(u) for u, share in zip(e.units, e.by_public) if share >= 0.5}
                e = Expectation(self, unit, p, n, c)
                e.share, e.free = self.share, _START[2]
            e.step(self.share0 * _PRIOR, _START[2] * _PRIOR)
            self.share, self.free = e.share, e.free
            self._fit(own, p, n, np.where(got, e.as_itself, 0.0))
        self.table = e.learnt_table()

    def usual(self, x: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How often the corpus has x between p and n, by its raw counts."""
        return self.raw[0][x, p] * self.raw[1][x, n] / np.maximum(self.total[x], 1.0)

    def _fit(self, own: np.ndarray, p: np.ndarray, n: np.ndarray, weight: np.ndarray) -> None:
        m, k = len(self.names), len(_PLACES)
        got = own >= 0
        logs = []
        for at in (p, n):
            table = np.zeros((m, k))
            np.add.at(table, (own[got], at[got]), weight[got])
            by_class = np.zeros((self.kind.max() + 1, k))
            np.add.at(by_class, self.kind, table)
            by_class = (by_class + 0.01) / (by_class + 0.01).sum(axis=1, keepdims=True)
            logs.append(np.log((table + _SMOOTH * by_class[self.kind]) / (table.sum(axis=1, keepdims=True) + _SMOOTH)))
        self.before, self.after = logs
        used = np.bincount(own[got], weight[got], m) + 0.5
        self.often = np.log(used / used.sum())

    def itself(self, unit: str, p: int, n: int) -> float:
        """Logarithm of the likelihood of a unit that is rightly there, all its characters."""
        total, last, foreign = 0.0, len(unit) - 1, _PLACE[_FOREIGN]
        for k, c in enumerate(unit):
            a, z = p if k == 0 else foreign, n if k == last else foreign
            x = self.number.get(c)
            if x is None:
                kind = _foreign_kind(c)
                total += _FOREIGN_RATE[kind] + _FOREIGN_NEAR[kind, a] + _FOREIGN_NEAR[kind, z]
            else:
                total += self.often[x] + self.before[x, a] + self.after[x, z]
        return float(total)


class Expectation:
    """The two steps over a table of (before, unit, after) counts; one column per character in use."""

    def __init__(self, model: Model, unit: np.ndarray, p: np.ndarray, n: np.ndarray, c: np.ndarray) -> None:
        self.model, self.p, self.n, self.c = model, p, n, c
        # the characters of units that no public swap makes are units too: they may each have come about by themselves
        apart = sorted({ch for u in set(unit) if len(u) > 1 and u not in model.cipher.originals for ch in u})
        self.units, of = np.unique(np.concatenate([unit, np.array(apart, dtype=object)]).astype(str), return_inverse=True)
        self.of = of[: len(unit)]
        m, x = len(self.units), len(model.names)
        entries = [(k, model.number[o], z) for k, u in enumerate(self.units) for o, z in model.cipher.originals.get(u, ()) if o != u]
        self.eu, self.ex, self.ez = (np.array(a, dtype=np.int64) for a in zip(*entries)) if entries else (np.empty(0, dtype=np.int64),) * 3
        self.own = np.array([model.number.get(u, -1) for u in self.units])
        self.share, self.free = model.share, model.free
        # the unknown swap makes nothing that is in use
        self.may = np.array([u != LOST and not model.explained & {u, *u} and not all(ch in model.number for ch in u) for u in self.units])
        self.phi = np.zeros((m, x))
        for k, u in enumerate(self.units):
            if self.may[k]:
                self.phi[k] = np.maximum(model.table.get(u, 0.0), 1.0 / _POSSIBLE)
        # and can't stand for it more often than half that one's own occurrences
        self.most = np.where(self.own[:, None] >= 0, model.total[None, :] * 0.5, np.inf)
        # the characters of all units, for the likelihood that they are rightly there
        foreign = _PLACE[_FOREIGN]
        chars = [(r, model.number.get(ch, -1), _foreign_kind(ch), int(p[r]) if j == 0 else foreign, int(n[r]) if j == len(self.units[k]) - 1 else foreign) for r, k in enumerate(self.of) for j, ch in enumerate(self.units[k])]
        self.row, self.x, self.sort, self.a, self.z = (np.array(v, dtype=np.int64) for v in zip(*chars))
        number = {str(u): k for k, u in enumerate(self.units)}
        letters = [ch for k in self.of for ch in self.units[k]]
        alone = [len(self.units[k]) > 1 and str(self.units[k]) not in model.cipher.originals for k in self.of for _ in self.units[k]]
        self.apart = np.flatnonzero(alone)
        self.apart_unit = np.array([number[letters[k]] for k in self.apart], dtype=np.int64)

    def itself(self) -> np.ndarray:
        """``Model.itself`` of every row; the characters of a unit of the unknown swap may also have been swapped one by one."""
        m, known = self.model, self.x >= 0
        x = np.maximum(self.x, 0)
        inside = m.often[x] + m.before[x, self.a] + m.after[x, self.z]
        outside = _FOREIGN_RATE[self.sort] + _FOREIGN_NEAR[self.sort, self.a] + _FOREIGN_NEAR[self.sort, self.z]
        each = np.where(known, inside, outside)
        if len(self.apart):
            a, z = self.a[self.apart], self.z[self.apart]
            swapped = (self.any[self.apart_unit] * np.exp(m.often[None, :] + m.before[:, a].T + m.after[:, z].T)).sum(axis=1)
            each[self.apart] = np.log(np.exp(each[self.apart]) + swapped)
        return np.bincount(self.row, each, len(self.c))

    def emission(self) -> np.ndarray:
        """Probability that an original becomes the unit, by any swap."""
        e = np.zeros((len(self.units), len(self.model.names)))
        np.add.at(e, (self.eu, self.ex), self.share[self.ez])
        self.public = e
        self.any = e + self.free * self.phi
        return self.any

    def step(self, prior: np.ndarray, free_prior: float) -> None:
        m = self.model
        e = self.emission()
        rightly = np.exp(self.itself()) * max(1e-9, 1.0 - float(self.share.sum()) - self.free)
        total = np.zeros_like(e)
        self.as_itself = np.zeros(len(self.c))
        for part in np.array_split(np.arange(len(self.c)), len(self.c) // 20_000 + 1):
            u, p, n = self.of[part], self.p[part], self.n[part]
            w = e[u] * np.exp(m.often[None, :] + m.before[:, p].T + m.after[:, n].T)
            # most text is right: a character in use stands for another one only where that one is the commoner between the same neighbours
            used = np.flatnonzero(self.own[u] >= 0)
            usual = m.usual(np.arange(len(m.names))[None, :], p[used][:, None], n[used][:, None])
            w[used] = np.where(usual > usual[np.arange(len(used)), self.own[u[used]]][:, None], w[used], 0.0)
            norm = np.maximum(w.sum(axis=1) + rightly[part], 1e-300)
            np.add.at(total, u, w * (self.c[part] / norm)[:, None])
            self.as_itself[part] = rightly[part] / norm * self.c[part]
        total = np.minimum(total, self.most)
        n_all = float(self.c.sum())
        with np.errstate(invalid="ignore", divide="ignore"):
            by = np.where(e[self.eu, self.ex] > 0, total[self.eu, self.ex] * self.share[self.ez] / e[self.eu, self.ex], 0.0)
            emitted = np.where(e > 0, total * (e - self.public) / e, 0.0)
        self.by_public = np.where(e > 0, total * self.public / np.maximum(e, 1e-300), 0.0).sum(axis=1) / np.maximum(np.bincount(self.of, self.c, len(self.units)), 1.0)
        self.found, self.emitted = np.bincount(self.ez, by, len(self.share)), emitted
        self.share = (self.found + prior) / (n_all + _PRIOR)
        self.free = (float(emitted.sum()) + free_prior) / (n_all + _PRIOR)
        base = 1.0 / _POSSIBLE
        self.phi = np.where(self.may[:, None], (emitted + base * _UNSEEN) / (emitted.sum(axis=0)[None, :] + _UNSEEN), 0.0)

    def learnt_table(self) -> dict[str, np.ndarray]:
        """Units of the unknown swap that occur more than now and then.

        A character is either a unit or a part of units, whichever it is more often; and a cipher
        makes one original of a unit, where one has most of it.
        """
        weight = {str(u): float(w) for u, w in zip(self.units, self.emitted.sum(axis=1)) if w >= 2.0}
        part: dict[str, float] = {}
        for u, w in weight.items():
            if len(u) > 1:
                for ch in set(u):
                    part[ch] = part.get(ch, 0.0) + w
        out = {}
        for k, u in enumerate(map(str, self.units)):
            if u in weight and (all(part[ch] > weight.get(ch, 0.0) for ch in u) if len(u) > 1 else weight[u] >= part.get(u, 0.0)):
                best = int(self.emitted[k].argmax())
                sole = self.emitted[k, best] >= 0.5 * weight[u]
                out[u] = np.where(np.arange(self.phi.shape[1]) == best, self.phi[k], 0.0) if sole else self.phi[k]
        return out


def learn_source(counts: pd.DataFrame, model: Model) -> tuple[dict[int, float], float, dict[str, dict[str, float]]]:
    """Shares of the swaps that are found in one source, of the unknown swap, and its table, from the corpus as prior."""
    p, n = counts["p"].map(_PLACE).to_numpy(), counts["n"].map(_PLACE).to_numpy()
    e = Expectation(model, counts["unit"].to_numpy(dtype=object), p, n, counts["count"].to_numpy(dtype="float64"))
    prior, free = model.share * _CORPUS, model.free * _CORPUS
    for _ in range(4):
        e.step(prior, free)
    # swaps that do the same to what is here share its occurrences
    least = min(0.3, max(0.1, 0.5 * float(e.found.max(initial=0.0))))
    found = {int(z): float(e.share[z]) for z in np.flatnonzero(e.found >= least)}
    table = {}
    for u, row in e.learnt_table().items():
        table[u] = {model.names[x]: float(row[x]) for x in np.flatnonzero(row > 1.5 / _POSSIBLE)}
    return found, float(e.free), table


class Reader:
    """Judges every unit of a text by the swaps of its source and its two neighbours."""

    def __init__(self, model: dict, found: dict[int, float], free: float, table: dict[str, dict[str, float]]) -> None:
        self.__dict__.update(model)
        self.found, self.free, self.table = found, free, table
        self.right = max(1e-9, 1.0 - sum(found.values()) - free)
        # the swaps of the source come to the fore; those found elsewhere in the corpus stay possible
        several = {u for u in self.originals if len(u) > 1} | {u for u in table if len(u) > 1}
        self.cutter = Cutter(several, set(self.clean), False)
        self.memo: dict[tuple[str, str, str], tuple[bool, list]] = {}
        self.runs: dict[tuple[str, str, str], bool] = {}
        self.known: dict[str, tuple] = {}

    def behind(self, p: str, unit: str, n: str) -> tuple[bool, list[tuple[float, str, int]]]:
        """Whether the unit is wrong, and the (weight, original, swap) behind it; swap -1 is the unknown one."""
        key = (p, unit, n)
        if key not in self.memo:
            self.memo[key] = self._behind(p, unit, n)
        return self.memo[key]

    def _behind(self, p: str, unit: str, n: str) -> tuple[bool, list[tuple[float, str, int]]]:
        if unit == LOST:
            return True, []
        m = self.shape
        a, z = _PLACE[p], _PLACE[n]
        own = m.number.get(unit)
        xs, swaps, rates = self.candidates(unit, own)
        out = []
        if len(xs):
            w = rates * np.exp(m.often[xs] + m.before[xs, a] + m.after[xs, z])
            if own is not None:
                usual = m.raw[0][xs, a] * m.raw[1][xs, z] / np.maximum(m.total[xs], 1.0)
                w[usual <= m.raw[0][own, a] * m.raw[1][own, z] / max(m.total[own], 1.0)] = 0.0
            out = [(v, m.names[x], s) for v, x, s in zip(w.tolist(), xs.tolist(), swaps) if v]
        right = self.right * float(np.exp(m.itself(unit, a, z)))
        wrong = sum(w for w, _, _ in out)
        if not out:
            return len(unit) == 1 and 0x80 <= ord(unit) <= 0x9F, []
        return wrong > right * (ODDS if own is not None else 1.0), out

    def candidates(self, unit: str, own: int | None) -> tuple[np.ndarray, list[int], np.ndarray]:
        """Originals that a unit may stand for, the swaps and their rates, whatever its neighbours."""
        got = self.known.get(unit)
        if got is None:
            number = self.shape.number
            mine = [(number[x], s, self.found.get(s, self.corpus[s])) for x, s in self.originals.get(unit, ()) if x != unit]
            if own is None:
                mine += [(number[x], -1, self.free * phi) for x, phi in self.table.get(unit, {}).items()]
            xs, swaps, rates = zip(*mine) if mine else ((), (), ())
            got = self.known[unit] = (np.array(xs, dtype=np.int64), list(swaps), np.array(rates))
        return got

    def suspect(self, place: tuple[str, str, str]) -> bool:
        """Whether a run between its neighbours has a wrong unit."""
        got = self.runs.get(place)
        if got is None:
            got = any(self.behind(p, u, n)[0] for p, u, n, _ in occurrences("".join(place), self.cutter))
            if len(self.runs) < _HELD:
                self.runs[place] = got
        return got

    def read(self, text: str) -> tuple[int, int, str]:
        """Wrong units, those without a sure original, and the text with the others replaced."""
        if not any(map(self.suspect, set(places(text)))):
            return 0, 0, text
        met = [(at, u, p, n, *self.behind(p, u, n)) for p, u, n, at in occurrences(text, self.cutter)]
        # the swaps of this document, by all its wrong units together
        shares: dict[int, float] = {}
        for _ in range(3):
            now: dict[int, float] = {}
            for _, _, _, _, bad, out in met:
                if bad and out:
                    weights = [w * (shares.get(s, 1e-4) if shares else 1.0) for w, _, s in out]
                    total = sum(weights) or 1.0
                    for (_, _, s), w in zip(out, weights):
                        now[s] = now.get(s, 0.0) + w / total
            total = sum(now.values()) or 1.0
            shares = {s: v / total for s, v in now.items()}
        wrong, lost, edits = 0, 0, []
        for at, unit, p, n, bad, out in met:
            by: dict[str, float] = {}
            for w, x, s in out:
                by[x] = by.get(x, 0.0) + w * (shares.get(s, 1e-4) / max(self.found.get(s, self.corpus[s]) if s >= 0 else self.free, 1e-300))
            total = sum(by.values())
            if not bad and out and total:
                # in a text with wrong units a character in use needs less to be one of them
                m = self.shape
                bad = total * 0.5 > ODDS * float(np.exp(m.itself(unit, _PLACE[p], _PLACE[n])))
            if not bad:
                continue
            wrong += 1
            x = max(sorted(by), key=by.get) if total else None
            if x is None or by[x] < SURE * total:
                lost += 1
            else:
                edits.append((at, unit, x))
        return wrong, lost, _apply(text, edits) if edits else text


def _apply(text: str, edits: list[tuple[int, str, str]]) -> str:
    """One ``translate`` where every occurrence of the wrong characters is to be replaced alike, else one replacement each."""
    table: dict[str, str] = {}
    alike = all(len(u) == 1 and table.setdefault(u, x) == x for _, u, x in edits)
    if alike and sum(text.count(u) for u in table) == len(edits):
        return text.translate(str.maketrans(table))
    out, last = [], 0
    for at, u, x in edits:
        out += [text[last:at], x]
        last = at + len(u)
    return "".join([*out, text[last:]])


class _Shape:
    """What readers need of a model: plain arrays."""

    def __init__(self, model: Model) -> None:
        for k in ("names", "number", "often", "before", "after", "raw", "total"):
            setattr(self, k, getattr(model, k))

    itself = Model.itself


def find_garbled(documents: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", pages: dict[str, str] | None = None) -> DataFrame:
    """The records with at least one wrong character: ``id``, ``n_wrong``, ``n_lost`` and ``restored``.

    ``n_wrong`` counts original characters that are wrong, ``n_lost`` those of them that can't
    be restored (bytes replaced by U+FFFD, or no original that is sure); ``restored`` is the text
    with the others put right, null where nothing could be.  ``pages`` names the code pages
    that swaps are made of (by default all of ``code_pages``); others are learnt as unknown.
    Defined cases: null and empty texts are never garbled; a null source is a source of its
    own; repeated records each give a row; missing accents, HTML entities, combining marks,
    redaction marks and words of other scripts are not wrong; texts are read whole; other
    columns aren't read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    # ASCII texts, and nothing else, have as many bytes as characters
    docs = docs.filter(F.octet_length("text") > F.length("text"))
    cipher = Cipher(pages)
    cutter = Cutter({u for u in cipher.originals if len(u) > 1}, set(cipher.clean), free=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str, str], int] = {}
        known: dict[tuple[str, str, str], list[tuple[str, str, str]]] = {}
        for batch in batches:
            for src, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                # a document counts once for what it has, so that one odd text doesn't outweigh the rest
                mine = set()
                for place in set(places(x.as_py())):
                    got = known.get(place)
                    if got is None:
                        got = [(p, u, n) for p, u, n, _ in occurrences("".join(place), cutter) if len(u) == 1 or u in cutter.several or _LATIN[_PLACE[p]] or _LATIN[_PLACE[n]]]
                        if len(known) < _HELD:
                            known[place] = got
                    mine.update(got)
                for p, u, n in mine:
                    held[src, p, u, n] = held.get((src, p, u, n), 0) + 1
                if len(held) > _HELD:
                    yield _counted(held)
                    held = {}
        yield _counted(held)

    counted = docs.select("source", "text").mapInArrow(count, "source string, p string, unit string, n string, count long")
    counts = durable(counted.groupBy("source", "p", "unit", "n").agg(F.sum("count").alias("count")))
    overall = counts.groupBy("p", "unit", "n").agg(F.sum("count").alias("count")).toArrow().to_pandas()
    shape = f"id {documents.schema[id].dataType.simpleString()}, n_wrong long, n_lost long, restored string"
    if overall.empty:
        return spark.createDataFrame([], shape).withColumnRenamed("id", id)
    model = Model(cipher, overall.sort_values(["p", "unit", "n"], ignore_index=True))
    learning = spark.sparkContext.broadcast(packed(model))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        found, free, table = learn_source(pdf.sort_values(["p", "unit", "n"], ignore_index=True), unpacked(learning.value))
        rows = [(None, None, z, w) for z, w in found.items()] + [(None, None, -1, free)] + [(u, x, -1, w) for u, xs in table.items() for x, w in xs.items()]
        out = pd.DataFrame(rows, columns=["unit", "original", "swap", "weight"])
        out.insert(0, "source", pdf["source"].iloc[0])
        return out

    # a few rows per source
    learnt = durable(counts.groupBy("source").applyInPandas(learn, "source string, unit string, original string, swap int, weight double"))
    used = {r["swap"] for r in learnt.filter("swap >= 0").select("swap").distinct().collect()}
    originals: dict[str, list[tuple[str, int]]] = {}
    for u, xs in cipher.originals.items():
        mine = [(x, z) for x, z in xs if z in used]
        if mine:
            originals[u] = mine
    base = {"originals": originals, "clean": cipher.clean, "corpus": {z: float(model.share[z]) for z in used}, "shape": _Shape(model)}
    parts = max(1, -(-learnt.select("source").distinct().count() // MOST_SOURCES))
    results = []
    for part in range(parts):
        mine = F.pmod(F.xxhash64("source"), F.lit(parts)) == part
        sources: dict[str, tuple[dict, float, dict]] = {}
        for r in learnt.filter(mine).collect():
            found, free, table = sources.get(r["source"], ({}, 0.0, {}))
            if r["unit"] is not None:
                table.setdefault(r["unit"], {})[r["original"]] = r["weight"]
            elif r["swap"] >= 0:
                found[r["swap"]] = r["weight"]
            else:
                free = r["weight"]
            sources[r["source"]] = (found, free, table)
        sent = spark.sparkContext.broadcast(packed((base, sources)))

        def apply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            base, sources = unpacked(sent.value)
            readers: dict[str, Reader] = {}
            for batch in batches:
                rows = []
                for k, (src, x) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                    reader = readers.get(src) or readers.setdefault(src, Reader(base, *sources.get(src, ({}, 0.0, {}))))
                    wrong, lost, fixed = reader.read(x.as_py())
                    if wrong:
                        rows.append((k, wrong, lost, fixed if wrong > lost else None))
                if rows:
                    at, wrong, lost, fixed = zip(*rows)
                    yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(wrong, pa.int64()), pa.array(lost, pa.int64()), pa.array(fixed, pa.string())], names=["id", "n_wrong", "n_lost", "restored"])

        results.append((docs.filter(mine) if parts > 1 else docs).mapInArrow(apply, shape))
    return reduce(DataFrame.unionByName, results).withColumnRenamed("id", id)


def _counted(held: dict[tuple[str, str, str, str], int]) -> pa.RecordBatch:
    cols = list(zip(*held)) if held else [[], [], [], []]
    return pa.record_batch([*[pa.array(c, pa.string()) for c in cols], pa.array(list(held.values()), pa.int64())], names=["source", "p", "unit", "n", "count"])
