"""License scans by patience alignment.

A text and a template are sequences of lower-case words. Around each place where a rare word
of a template occurs, the region of the text that could hold the template is aligned with
it: words that occur once in both are anchors, the longest increasing subsequence of
their places is kept, and the gaps between anchors are aligned in the same way; a gap
without anchors, of any size, matches its equal ends and its longest common subsequence.
Coverage is the share of template words that are matched.

A template needs ``COVERAGE`` of its words, so a text without any of its rarest
1 - COVERAGE of words (and one more) can't hold it; one pass of an Aho-Corasick automaton
finds the texts that go on to alignment. Templates are the fixed list of
``license_texts``, whole texts among them, sent with the code.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.llm.license_texts import TEMPLATES

COVERAGE = 0.8
#: Cells of the table by which a gap without anchors is aligned; larger gaps are parted first.
TABLE_CELLS = 1 << 20
_WORD = re.compile(r"[^\W_]+")

#: Words that are never taken as a template's rare ones while it has others.
COMMON = frozenset("a an and any are at by copy following for free general in is it may not of on or software source terms that the this to use version with work you 0 2 3 4".split())


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, ordered by their first, whose seconds increase."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, second) in enumerate(pairs):
        k = bisect_left(tails, second)
        if k == len(tails):
            tails.append(second)
            ends.append(i)
        else:
            tails[k], ends[k] = second, i
        back[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of b and each beginning of a."""
    row = np.zeros(len(a) + 1, np.int32)
    for word in b:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(a == word, row[:-1] + 1, 0)))
    return row


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence of two sequences of numbers.

    Sequences over ``TABLE_CELLS`` are parted where both sides together are longest (Hirschberg), so
    memory grows with their lengths alone.
    """
    if not len(a) or not len(b):
        return []
    if len(a) * len(b) > TABLE_CELLS and len(b) > 1:
        half = len(b) // 2
        cut = int((_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]).argmax())
        return _common(a[:cut], b[:half]) + [(cut + i, half + j) for i, j in _common(a[cut:], b[half:])]
    table = np.zeros((len(b) + 1, len(a) + 1), np.int32)
    for j in range(len(b) - 1, -1, -1):
        best = np.maximum(table[j + 1, :-1], np.where(a == b[j], table[j + 1, 1:] + 1, 0))
        table[j, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[j, i + 1] >= table[j + 1, i]:
            i += 1
        else:
            j += 1
    return out


def _numbered(*parts: list[str]) -> list[np.ndarray]:
    """Sequences of words as numbers, equal for equal words."""
    known: dict[str, int] = {}
    return [np.array([known.setdefault(w, len(known)) for w in part], np.int64) for part in parts]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in text, in template) of a patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        own, other = Counter(text[a:b]), Counter(template[c:d])
        places = {w: i for i, w in enumerate(text[a:b], a) if own[w] == 1 and other.get(w) == 1}
        anchors = increasing(sorted((places[w], j) for j, w in enumerate(template[c:d], c) if w in places))
        if anchors:
            out += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:]) if x + 1 < u and y + 1 < v]
        else:
            out += [(a + i, c + j) for i, j in _common(*_numbered(text[a:b], template[c:d]))]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates: list[tuple[str, list[str], dict[str, list[int]]]] = []
        self.automaton = ahocorasick.Automaton()
        known: dict[str, list[int]] = {}
        for name, texts in templates.items():
            for text in texts:
                words = words_of(text)
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    places.setdefault(w, []).append(i)
                rare, left = {}, len(words) - int(np.ceil(coverage * len(words) - 1e-9)) + 1
                for w in sorted(places, key=lambda w: (w in COMMON, len(places[w]), -len(w), w)):
                    if left <= 0:
                        break
                    rare[w] = places[w]
                    left -= len(places[w])
                for w in rare:
                    known.setdefault(w, []).append(len(self.templates))
                self.templates.append((name, words, rare))
        for w, owners in known.items():
            self.automaton.add_word(w, owners)
        if known:
            self.automaton.make_automaton()
        self.any = bool(known)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of the best match of each license."""
        if not text or not self.any:
            return []
        maybe: set[int] = set()
        for _, owners in self.automaton.iter(text.lower()):
            maybe.update(owners)
        if not maybe:
            return []
        words, best = words_of(text), {}
        at: dict[str, list[int]] = {}
        wanted = {w for t in maybe for w in self.templates[t][2]}
        for i, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(i)
        for t in sorted(maybe):
            name, template, rare = self.templates[t]
            slack = len(template) // 4 + 2
            spans = sorted((max(0, p - i - slack), min(len(words), p - i + len(template) + slack)) for w, places in rare.items() for p in at.get(w, ()) for i in places)
            for lo, hi in _merged(spans, 8 * len(template)):
                matched = patience(words[lo:hi], template)
                share = len(matched) / len(template)
                if share >= self.coverage and share > best.get(name, (0,))[0]:
                    best[name] = (share, lo + matched[0][0], lo + matched[-1][0] + 1)
        # a license whose words lie far apart fills no region; its words must all be there, however far apart they are
        apart = [t for t in sorted(maybe) if self.templates[t][0] not in best]
        counts = Counter(words) if apart else Counter()
        for t in apart:
            name, template, _ = self.templates[t]
            if (counts & Counter(template)).total() >= self.coverage * len(template) - 1e-9:
                matched = patience(words, template)
                share = len(matched) / len(template)
                if share >= self.coverage and share > best.get(name, (0,))[0]:
                    best[name] = (share, matched[0][0], matched[-1][0] + 1)
        return [(name, *found) for name, found in sorted(best.items())]


def _merged(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Spans with those inside one another joined, while they stay short."""
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1] and max(hi, out[-1][1]) - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        elif not out or (lo, hi) != out[-1]:
            out.append((lo, hi))
    return out


_FOUND = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())])


def _scanned(batches: Iterator[pa.RecordBatch], templates: dict[str, list[str]], coverage: float) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, coverage)
    for batch in batches:
        found = [[dict(zip(("license", "coverage", "first_word", "last_word"), f)) for f in scanner.scan(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=pa.list_(_FOUND))], names=["doc_id", "licenses"])


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Licenses whose templates a document holds.

    docs: doc_id long and text string; other columns are ignored, whatever their names.
    Returns, for each row, doc_id and licenses: an array, by name, of the license, its best
    coverage (matched words over template words, at least the given share) and the words of
    the text from first_word to before last_word. Words are runs of letters and digits.
    Regions around a license's rare words are aligned first; where none of them holds the license, but the text
    as a whole has enough of its words, the whole text is aligned, so words between its words hide no license.

    Null and empty texts hold none. Ties in coverage go to the earliest template and
    place. Repeated rows give equal rows; a null doc_id stays null. No rows are shuffled.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_scanned, templates=templates, coverage=coverage),
        "doc_id long, licenses array<struct<license:string,coverage:double,first_word:int,last_word:int>>",
    )
