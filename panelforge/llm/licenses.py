"""License scans: exact phrases, and short notices with a bounded number of edits.

A text is reduced to its words (A-Z lower-cased, ASCII marks dropped) with one space between. Base
phrases count where their words stand consecutively. A notice of ``n`` characters may differ by
``k = n // 12`` edits (1 at least, none under 10 characters): cut into k + 1 pieces, one piece must
stand unchanged (pigeonhole), so exact searches for the pieces find every candidate, and the regex
library's bounded-error matching verifies it and tells where it lies. A match starts and ends with words.

Defined results: a null text is empty: no words, no labels, score 0.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .common import alnum_words, text_bytes

#: Phrases whose words count exactly, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices searched with edits, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "apache license": "apache",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}


class Notice:
    """A phrase with its edits, seeds and verifier."""

    def __init__(self, phrase: str, label: str):
        self.label, self.text = label, phrase.encode()
        n = len(self.text)
        self.edits = max(1, n // 12) if n >= 10 else 0
        cuts = [n * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(b"(?b) (?! )(?:" + regex.escape(self.text, literal_spaces=True) + b"){e<=%d}(?<! )(?= )" % self.edits)

    def spans(self, line: bytes) -> list[tuple[int, int, int]]:
        """(from, to, edits) of matches in a line of words with a space at both ends; the best of those that overlap."""
        n, k, tried, found = len(self.text), self.edits, set(), []
        for offset, seed in self.seeds:
            at = line.find(seed)
            while at >= 0:
                begin, end = max(0, at - offset - k - 1), min(len(line), at - offset + n + k + 1)  # with the space on either side
                if (begin, end) not in tried:
                    tried.add((begin, end))
                    for m in self.pattern.finditer(line, begin, end, overlapped=True):
                        found.append((sum(m.fuzzy_counts), m.start() + 1, m.end()))
                at = line.find(seed, at + 1)
        best: list[tuple[int, int, int]] = []
        for d, a, b in sorted(found):
            if all(b <= x or a >= y for x, y, _ in best):
                best.append((a, b, d))
        return sorted(best)


def scan(raw: bytes, base: dict[str, str] = BASE, notices: list[Notice] | None = None) -> dict:
    """What a text holds: ``n_words``, ``places`` (word, phrase) of base phrases, ``spans`` (label, first word, word after, edits), ``score``."""
    words = alnum_words(raw)
    line = b" " + b" ".join(words) + b" "
    places, found, best = [], [], 0.0
    for phrase, label in base.items():
        wanted, at = b" " + phrase.encode() + b" ", -1
        while (at := line.find(wanted, at + 1)) >= 0:
            places.append((at, label))
    for notice in NOTICE_LIST if notices is None else notices:
        for a, b, d in notice.spans(line):
            found.append((a, b, notice.label, d))
            best = max(best, 1 - d / len(notice.text))
    count, last = 0, 0  # words before a place: spaces passed so far

    def word(at: int) -> int:
        nonlocal count, last
        count += line.count(b" ", last, at)
        last = at
        return count

    starts = [(word(at), label) for at, label in sorted(places)]
    count, last = 0, 0
    spans = [(label, word(a) - 1, line.count(b" ", a, b), d) for a, b, label, d in sorted(found)]
    return {"n_words": len(words), "places": starts, "spans": [(x, s, s + n + 1, d) for x, s, n, d in spans], "score": 1.0 if starts else best}


NOTICE_LIST = [Notice(p, x) for p, x in NOTICES.items()]
_SCHEMA = "__id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,after:long,edits:int>>"


def scan_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``spans``."""
    rows = docs.select(F.col(id_col).alias("__id"), text_bytes().alias("__text"))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("edits", pa.int32())]))

    def run(batches):
        for b in batches:
            found = [scan(t.as_py()) for t in b.column(1)]
            base = [sorted({x for _, x in f["places"]}) for f in found]
            columns = [
                b.column(0),
                pa.array([f["n_words"] for f in found], pa.int64()),
                pa.array([len(f["places"]) for f in found], pa.int64()),
                pa.array([f["places"][0][0] if f["places"] else None for f in found], pa.int64()),
                pa.array([f["places"][-1][0] if f["places"] else None for f in found], pa.int64()),
                pa.array([",".join(x) for x in base], pa.string()),
                pa.array([",".join(sorted({*x, *(s[0] for s in f["spans"])})) for x, f in zip(base, found, strict=True)], pa.string()),
                pa.array([f["score"] for f in found], pa.float64()),
                pa.array([[dict(zip(("label", "first", "after", "edits"), s, strict=True)) for s in f["spans"]] for f in found], span),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return rows.mapInArrow(run, _SCHEMA.format(rows.schema["__id"].dataType.simpleString())).withColumnRenamed("__id", id_col)
