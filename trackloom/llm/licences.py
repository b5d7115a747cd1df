"""License scans: fuzzy search for short notices.

A notice with up to k edits holds one of k + 1 pieces unchanged. Aho-Corasick finds pieces; around
each, the regex library matches the notice with bounded errors and reports the span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Base phrases, then short notices; words in lower case.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license": "gpl",
    "free software you can redistribute it and or modify it under the terms": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: One edit for so many characters, one at least and three at most.
PER_EDIT, MOST_EDITS = 16, 3


class Notices:
    """Pieces of all notices in one automaton, and a bounded-error pattern for each."""

    def __init__(self, notices: dict[str, str]):
        self.texts, self.labels = list(notices), list(notices.values())
        self.edits = [min(MOST_EDITS, max(1, len(t) // PER_EDIT - 1)) for t in self.texts]
        self.patterns = [regex.compile(rf"(?b)\b(?:{regex.escape(t)}){{e<={k}}}\b") for t, k in zip(self.texts, self.edits)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (text, k) in enumerate(zip(self.texts, self.edits)):
            cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                pieces.setdefault(text[lo:hi], []).append((n, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def spans(self, plain: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in ``plain``, without repeats, sorted. An edited find gives way to one with fewer edits that it overlaps."""
        found, tried = set(), set()
        for end, (size, places) in self.automaton.iter(plain):
            for n, offset in places:
                start, k = end - size + 1 - offset, self.edits[n]
                if (n, start) in tried:
                    continue
                tried.add((n, start))
                lo, hi = max(0, start - 2 * k - 1), start + len(self.texts[n]) + 2 * k + 1
                if m := self.patterns[n].search(plain, lo, hi):
                    found.add((m.start(), m.end(), n, sum(m.fuzzy_counts)))
        return _least_edited(sorted(found))


def _least_edited(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Finds in order without those that overlap a find of fewer edits; one sweep for each number of edits."""
    kept = [f for f in found if not f[3]]
    for k in sorted({f[3] for f in found} - {0}):
        firm, at, reach, more = sorted(kept), 0, 0, []
        for f in (f for f in found if f[3] == k):
            while at < len(firm) and firm[at][0] <= f[0]:
                reach, at = max(reach, firm[at][1]), at + 1
            if reach <= f[0] and (at == len(firm) or firm[at][0] >= f[1]):
                more.append(f)
        kept += more
    return sorted(kept)


def word_numbers(plain: str, starts: list[int]) -> list[int]:
    """The number of the word at each of the ascending ``starts``, in one pass."""
    out, seen, n = [], 0, 0
    for at in starts:
        n, seen = n + plain.count(" ", seen, at), at
        out.append(n)
    return out


def scan(text: str | None, notices: Notices) -> tuple:
    """n_words, word places of base phrases, base labels, labels, spans, score."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    words = WORD.findall(low)
    plain = " ".join(words)
    places, base = [], set()
    for phrase, label in PHRASES.items():
        at, starts = plain.find(phrase), []
        while at >= 0:
            end = at + len(phrase)
            if (at == 0 or plain[at - 1] == " ") and (end == len(plain) or plain[end] == " "):
                starts.append(at)
                base.add(label)
            at = plain.find(phrase, at + 1)
        places += word_numbers(plain, starts)
    spans = notices.spans(plain)
    numbers = word_numbers(plain, [a for a, *_ in spans])
    labels = base | {notices.labels[n] for _, _, n, _ in spans}
    score = 1.0 if base else max((1 - k / len(notices.texts[n]) for _, _, n, k in spans), default=0.0)
    return len(words), places, base, labels, [(w, notices.labels[n], plain[a:b], k) for w, (a, b, n, k) in zip(numbers, spans)], score


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<word:bigint,label:string,found:string,edits:bigint>>"
)


def scan_licences(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Scan every whole ``text`` for license phrases and, with few edits, for short notices.

    Returns one row per input row: doc_id, number of words, places of the base phrases and their first
    and last word (null without one), base labels, all labels, a score (1 with a base phrase, else 1
    less the edits' share of the best notice, else 0), and the notices' spans: first word, label, what
    stands there, edits. Null and empty texts have no words. Overlapping finds with as many edits are
    all reported.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    engine = Notices(notices)
    spans_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("found", pa.string()), ("edits", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py(), engine) for t in batch.column("text")]
            named = lambda labels: ",".join(sorted(labels))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                    pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                    pa.array([named(r[2]) for r in rows], pa.string()),
                    pa.array([named(r[3]) for r in rows], pa.string()),
                    pa.array([r[5] for r in rows], pa.float64()),
                    pa.array([[dict(zip(("word", "label", "found", "edits"), s)) for s in r[4]] for r in rows], spans_type),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
