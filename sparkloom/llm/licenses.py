"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and cut into words. An Aho-Corasick automaton over all
rules' keywords finds in one pass which keywords a text holds; only rules whose
keywords are all there run their regex. Detections are word intervals. They are
taken by priority, then length, then order of the rules; one that lies inside the
interval of a detection already taken is suppressed. Base phrases always count.

Nulls: a null text is empty and has no words or labels. Repeated rows get equal
rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .license_rules import RULES
from .textcore import NOT_ALNUM, Chunk

#: phrase: label
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long,rule:int>>"


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    priority: int
    keywords: tuple[str, ...]
    regex: re.Pattern


@cache
def rules() -> tuple[Rule, ...]:
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keywords, regex = (x.strip() for x in line.split(" | ", 3))
        out.append(Rule(len(out), label, int(priority), tuple(keywords.split()), re.compile(rf"(?<![^ ])(?:{regex})(?![^ ])")))
    return tuple(out)


@cache
def prefilter() -> ahocorasick.Automaton:
    """All keywords of all rules."""
    found = ahocorasick.Automaton()
    for k in {k for r in rules() for k in r.keywords}:
        found.add_word(k, k)
    found.make_automaton()
    return found


def candidates(text: str) -> list[Rule]:
    """Rules whose keywords all begin a word of the lower-cased text."""
    held = set()
    for end, k in prefilter().iter(text):
        before = end - len(k)
        if k not in held and (before < 0 or not (text[before].isalnum() or text[before] > "\x7f")):
            held.add(k)
    return [r for r in rules() if held.issuperset(r.keywords)] if held else []


def normal(text: bytes) -> str:
    return b" ".join(WORD.findall(text.lower())).decode()


class Intervals:
    """Intervals that tell whether one of them holds another: only those not inside another are kept, by start and so by end."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def hold(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start) - 1
        return i >= 0 and self.ends[i] >= end

    def add(self, start: int, end: int) -> None:
        """An interval that none of them holds; those that it holds go."""
        i = bisect_right(self.starts, start)
        if i and self.starts[i - 1] == start:
            i -= 1
        j = bisect_right(self.ends, end)
        self.starts[i:j], self.ends[i:j] = [start], [end]


def words_before(text: str, at: list[int]) -> list[int]:
    """Number of blanks before each place of a normalised text."""
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
    return np.searchsorted(blanks, at).tolist()


def scan(text: str, among: list[Rule]) -> list[tuple[str, int, int, int]]:
    """Detections (label, first word, word after the last, rule) of a normalised text, overlaps resolved, in text order."""
    found = [(-r.priority, m.start() - m.end(), r.order, m.start(), m.end(), r) for r in among for m in r.regex.finditer(text)]
    found.sort(key=lambda x: x[:4])
    held, taken = Intervals(), []
    for *_, start, end, r in found:
        if not held.hold(start, end):
            held.add(start, end)
            taken.append((start, end, r))
    taken.sort(key=lambda x: (x[0], x[1]))
    first, last = (words_before(text, [x[k] for x in taken]) if taken else [] for k in (0, 1))
    return [(r.label, i, j + 1, r.order) for (_, _, r), i, j in zip(taken, first, last, strict=True)]


def base_places(text: str) -> tuple[list[int], set[str]]:
    """Word index of every place of a base phrase, and the phrases' labels."""
    padded, found, labels = f" {text} ", [], set()
    for phrase, label in BASE.items():
        at = padded.find(needle := f" {phrase} ")
        while at >= 0:
            found.append(at)
            labels.add(label)
            at = padded.find(needle, at + 1)
    return words_before(padded, found) if found else [], labels


def _scan(batches):
    priorities = {r.order: r.priority for r in rules()}
    for batch in batches:
        ids, items = batch.column(0).to_pylist(), common.texts(batch.column(1))
        out: list[tuple] = []
        for a, b in common.chunks(items):
            counts = Chunk(items[a:b], NOT_ALNUM, lower=True).n_words
            for d in range(b - a):
                raw = items[a + d].lower()
                row = (ids[a + d], int(counts[d]), 0, None, None, "", "", 0.0, [])
                if among := candidates(raw.decode()):
                    text = normal(raw)
                    places, base = base_places(text)
                    found = scan(text, among)
                    labels = base | {x[0] for x in found}
                    quiet = 1.0
                    for x in found:
                        quiet *= 1 - priorities[x[3]] / 100
                    row = (ids[a + d], int(counts[d]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - quiet, [{"label": x[0], "start": x[1], "end": x[2], "rule": x[3]} for x in found])
                out.append(row)
        if out:
            detection = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.int32())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), detection)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document, see SCHEMA."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SCHEMA)
