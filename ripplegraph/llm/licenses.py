"""License scans: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z) and cut into words; rules are regular expressions over the words joined
by single blanks.  Hand-written signatures (``license_rules``) recognise notices, file headers and
passages of license texts; further rules recognise the names of license families and their versions.
A rule runs only in texts that hold the words it cannot do without.  A detection is suppressed when an
accepted one of better or equal priority contains its interval; longer ones come first.  Work is
n log n in the detections of a text, and linear in its length for each rule that runs.

Null texts are empty texts: no words, no labels, score 0.  Very long texts are scanned whole; every
row gives one row, repeated rows repeat; other columns are not read.  Detections alike in interval and
priority keep the better score, then the smaller label.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import WORD_TABLE
from ripplegraph.llm.license_rules import lines

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: family, name as it stands in words, keywords that must all occur, versions ("" where it has none).
FAMILIES = (
    ("mit", "mit", ("mit",), ("",)),
    ("x11", "x11", ("x11",), ("",)),
    ("isc", "isc", ("isc",), ("",)),
    ("zlib", "zlib(?: libpng)?", ("zlib",), ("",)),
    ("apache", "apache(?: software)?", ("apache",), ("1 0", "1 1", "2 0", "2")),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)", (), ("",)),
    ("bsd-3-clause", "(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd)", (), ("",)),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)", (), ("",)),
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", (), ("",)),
    ("gpl", "(?:gnu )?(?:gpl|general public)", (), ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("lgpl", "(?:gnu )?(?:lgpl|lesser general public|library general public)", (), ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", "(?:gnu )?(?:agpl|affero general public)", (), ("1 0", "3 0", "3")),
    ("gfdl", "(?:gnu )?(?:gfdl|fdl|free documentation)", (), ("1 1", "1 2", "1 3")),
    ("mpl", "(?:mpl|mozilla public)", (), ("1 0", "1 1", "2 0")),
    ("epl", "(?:epl|eclipse public)", (), ("1 0", "2 0")),
    ("edl", "(?:edl|eclipse distribution)", (), ("1 0",)),
    ("eupl", "(?:eupl|european union public)", (), ("1 0", "1 1", "1 2")),
    ("cddl", "(?:cddl|common development and distribution)", (), ("1 0", "1 1")),
    ("cpl", "(?:cpl|common public)", (), ("1 0",)),
    ("cecill", "cecill(?: b| c)?", ("cecill",), ("1 0", "2 0", "2 1")),
    ("artistic", "artistic", ("artistic",), ("1 0", "2 0")),
    ("bsl", "(?:bsl|boost software)", (), ("1 0",)),
    ("busl", "(?:busl|business source)", (), ("1 1",)),
    ("sspl", "(?:sspl|server side public)", (), ("1 0", "1")),
    ("elastic", "elastic", ("elastic",), ("1 0", "2 0")),
    ("osl", "(?:osl|open software)", (), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "(?:afl|academic free)", (), ("1 1", "2 0", "2 1", "3 0")),
    ("odbl", "(?:odbl|open database)", (), ("1 0",)),
    ("ofl", "(?:ofl|open font)", (), ("1 0", "1 1")),
    ("upl", "(?:upl|universal permissive)", (), ("1 0",)),
    ("psf", "(?:psf|python software foundation)", (), ("2 0", "2")),
    ("ruby", "ruby", ("ruby",), ("",)),
    ("php", "php", ("php",), ("3 0", "3 01")),
    ("openssl", "openssl", ("openssl",), ("",)),
    ("postgresql", "postgresql", ("postgresql",), ("",)),
    ("vim", "vim", ("vim",), ("",)),
    ("w3c", "w3c(?: software)?", ("w3c",), ("",)),
    ("ncsa", "(?:ncsa|university of illinois)", (), ("",)),
    ("ms-pl", "(?:ms pl|microsoft public)", (), ("",)),
    ("ms-rl", "(?:ms rl|microsoft reciprocal)", (), ("",)),
    ("beerware", "(?:beerware|beer ware)", (), ("",)),
    ("wtfpl", "wtfpl", ("wtfpl",), ("",)),
    ("unlicense", "unlicense", ("unlicense",), ("",)),
    *((f"cc-{k.replace(' ', '-')}", f"(?:cc {k}|creative commons {n})", (), ("1 0", "2 0", "2 5", "3 0", "4 0")) for k, n in (
        ("by nc nd", "attribution non ?commercial no ?derivatives"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc", "attribution non ?commercial"),
        ("by nd", "attribution no ?derivatives"), ("by sa", "attribution share ?alike"), ("by", "attribution"))),
    ("cc0", "(?:cc0|cc zero|creative commons zero)", (), ("1 0",)),
)

#: Ways of naming a license, best first: (form, score, pattern); {n} name, {v} version.
VERSIONED = (
    ("identifier", 1.0, r"spdx license identifier {n}(?: license)? {v}(?: only| or later)?"),
    ("grant", 0.95, r"(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of the )?{n}(?: public)?(?: licen[sc]e)?(?: version| v)? {v}"),
    ("named", 0.9, r"{n}(?: licen[sc]e)?(?: version| v)? {v}"),
)
PLAIN = (
    ("identifier", 1.0, r"spdx license identifier {n}"),
    ("grant", 0.85, r"(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of the )?{n}(?: licen[sc]e)?"),
    ("named", 0.7, r"{n} licen[sc]e"),
    ("address", 0.6, r"(?:opensource|spdx) org licenses? {n}"),
)


@dataclass(frozen=True)
class Rule:
    """``any_of``: one of these words must occur; ``all_of``: all of them."""

    label: str
    priority: int
    score: float
    any_of: frozenset[bytes]
    all_of: frozenset[bytes]
    pattern: re.Pattern[bytes]


def _compiled(pattern: str) -> re.Pattern[bytes]:
    return re.compile(f" {pattern}(?= )".encode())


def _required(pattern: str) -> frozenset[bytes]:
    """Words that stand in every match of a signature: whole words outside of groups, classes and optional parts."""
    bare = re.sub(r"\[[^\]]*\](?:\{[^}]*\}|\+)?\??", "\0", pattern)
    bare = re.sub(r"\(\?:[^()]*\)\??", "\0", bare)
    return frozenset(w.encode() for w in re.findall(r"(?<![^ ])[a-z0-9]+(?= [^?]|$)", bare))


def _lead(name: str) -> frozenset[bytes]:
    """Words one of which must occur for a family without stated keywords: the first words of its alternatives."""
    body = re.sub(r"\(\?:gnu \)\?", "", name)
    body = body.removeprefix("(?:").removesuffix(")")
    return frozenset(x.split()[0].encode() for x in body.split("|"))


def _label(family: str, version: str) -> str:
    """Whole versions are written with ``.0``; the base label of the Apache license stands for its version 2.0."""
    if not version:
        return family
    label = f"{family}-{version.replace(' ', '.')}" + (".0" if version.isdigit() else "")
    return "apache-2" if label == "apache-2.0" else label


def rules() -> list[Rule]:
    """All rules by priority: signatures, and versioned and plain forms of the family names."""
    out = [Rule(label, priority, score, frozenset(), _required(text), _compiled(text)) for label, priority, score, text in lines()]
    for rank, (forms, versioned) in enumerate(((VERSIONED, True), (PLAIN, False))):
        for at, (_, score, form) in enumerate(forms):
            for family, name, keywords, versions in FAMILIES:
                leads = frozenset(k.encode() for k in keywords) or _lead(name)
                for v in [x for x in versions if x] if versioned else [""]:
                    out.append(Rule(_label(family, v), rank * 10 + at, score, leads, frozenset(), _compiled(form.format(n=name, v=v))))
    return sorted(out, key=lambda r: r.priority)


class Cover:
    """Accepted intervals: is one of them around another interval?  A prefix maximum of ends over the sorted starts."""

    def __init__(self, starts: list[int]) -> None:
        self.starts = starts
        self.ends = [-1] * (len(starts) + 1)

    def holds(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        while i:
            if self.ends[i] >= end:
                return True
            i &= i - 1
        return False

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i


def order(found: tuple[int, int, Rule]) -> tuple:
    """Detections in the order in which they are accepted."""
    s, e, r = found
    return r.priority, s - e, s, -r.score, r.label


class Scanner:
    """Per-task state: the rules behind one word each that a text must hold for them."""

    def __init__(self) -> None:
        self.behind: dict[bytes, list[Rule]] = {}
        for r in rules():
            for w in r.any_of or [max(r.all_of, key=lambda w: (len(w), w))]:
                self.behind.setdefault(w, []).append(r)
        self.base = [(f" {p} ".encode(), label, frozenset(p.encode().split())) for p, label in BASE_PHRASES]

    def applicable(self, have: set[bytes]) -> list[Rule]:
        seen = {id(r): r for w in have & self.behind.keys() for r in self.behind[w] if r.all_of <= have}
        return list(seen.values())

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
        words = text.translate(WORD_TABLE).split()
        have = set(words)
        base = [(phrase, label) for phrase, label, need in self.base if need <= have]
        ready = self.applicable(have)
        if not base and not ready:
            return len(words), 0, None, None, "", "", 0.0, []
        joined = b" " + b" ".join(words) + b" "
        places: list[tuple[int, str]] = []
        for phrase, label in base:
            at = joined.find(phrase)
            while at >= 0:
                places.append((at, label))
                at = joined.find(phrase, at + 1)
        found = sorted(((m.start(), m.end(), r) for r in ready for m in r.pattern.finditer(joined)), key=order)
        cover = Cover(sorted({s for s, _, _ in found}))
        kept = []
        for s, e, r in found:
            if not cover.holds(s, e):
                cover.add(s, e)
                kept.append((s, e, r))
        kept.sort(key=lambda x: x[:2])
        # the blank before each word, and the one after the last
        blanks = np.cumsum([0, *(len(w) + 1 for w in words)]) if places or kept else None
        word = lambda at: np.searchsorted(blanks, at).tolist()
        starts = word([at for at, _ in places]) if places else []
        names = sorted({label for _, label in places})
        labels = sorted({*names, *(r.label for _, _, r in kept)})
        score = max([0.9 * bool(places), *(r.score for _, _, r in kept)])
        spans = zip(word([s for s, _, _ in kept]), word([e for _, e, _ in kept]), kept, strict=True) if kept else []
        marks = [{"start_word": a, "end_word": z, "label": r.label, "priority": r.priority} for a, z, (_, _, r) in spans]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(names), ",".join(labels), float(score), marks


OUT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<start_word:bigint,end_word:bigint,label:string,priority:int>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base phrase places, labels of all accepted detections, best score and the detections themselves."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            rows = [scanner.scan(t.as_py() or b"") for t in b.column(1)]
            cols = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(kinds)[1:], strict=True))], schema=kinds)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, OUT)
