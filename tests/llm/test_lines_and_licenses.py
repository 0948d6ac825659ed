"""Line dedup and license scan."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from ripplegraph.llm import licenses, linededup
from ripplegraph.llm.license_rules import lines
from tests.llm.conftest import EDGES


def test_lines_against_plain_python(make_docs):
    rows = EDGES + [(100 + i, "\n".join(["Site head", f"line {i}", "  Site head  ", "half" if i % 2 else "other", ""]), "en", f"h{i % 2}") for i in range(40)]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(make_docs(rows), ratio=0.5, min_pages=3).collect()), key=repr)
    pages, held = Counter(r[3] or "" for r in rows), Counter()
    for r in rows:
        held.update({(r[3] or "", x.strip(" ")) for x in (r[1] or "").split("\n")} if r[1] is not None else ())
    want = []
    for i, t, _, host in rows:
        lines = t.split("\n") if t is not None else []
        keep = [x for x in lines if not x.strip(" ") or not (held[host or "", x.strip(" ")] >= 3 and held[host or "", x.strip(" ")] > 0.5 * pages[host or ""])]
        want.append((i, t if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    assert got == sorted(want, key=repr)


def test_lines_of_empty_table_and_small_sites(make_docs, no_docs):
    out = linededup.dedup_lines(no_docs)
    assert out.collect() == [] and set(out.columns) == {*no_docs.columns, "n_lines", "n_dropped"}
    small = [(1, "a\nb", "en", "only"), (2, "a\nc", "en", "two"), (3, "a\nd", "en", "two")]
    assert sum(r["n_dropped"] for r in linededup.dedup_lines(make_docs(small)).collect()) == 0
    assert [r[0] for r in make_docs(small).limit(1).select(linededup.host_of(F.lit("HTTPS://u@Www.Ex.org:80/a?b"))).collect()] == ["www.ex.org"]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(make_docs, no_docs):
    texts = ["Under the MIT License; under the-mit-license", "Apache License, Version 2.0", "cc-by-nc cc by nc cc BY NC 4.0", "SPDX-License-Identifier: GPL-3.0-only", "mit einem Haus", "licensed under the Mozilla Public License 2.0 É", "apache license version 2x", "Licence: BSD 3-Clause License"]
    rows = EDGES + [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    got = licenses.scan_licenses(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], set()).add(plain(r[1]))
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in by_id[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[103] == "gpl-3.0" and labels[104] == "" and labels[105] == "mpl-2.0" and labels[107] == "bsd-3-clause"
    assert licenses.scan_licenses(no_docs).collect() == []
    assert len(lines()) > 200


def test_contained_detections_are_suppressed():
    *_, marks = licenses.Scanner().scan(b"Licensed under the GNU General Public License version 3.0, see the GNU General Public License")
    assert [m["label"] for m in marks] == ["gpl-3.0", "gpl"]


ALL = [(r, re.compile(r.pattern.pattern.decode())) for r in licenses.rules()]


def scanned_plainly(text):
    """Every rule over the whole text, every pair of detections, words counted one by one."""
    joined = " " + " ".join(WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))) + " "
    found = sorted(((m.start(), m.end(), r) for r, pattern in ALL for m in pattern.finditer(joined)), key=licenses.order)
    kept = []
    for s, e, r in found:
        if not any(a <= s and e <= b for a, b, _ in kept):
            kept.append((s, e, r))
    return sorted((joined[:s].count(" "), joined[:e].count(" "), r.label, r.priority) for s, e, r in kept)


def spelled(pattern):
    """A text that a rule must match: first alternatives, optional parts left out."""
    text = pattern.replace("[a-z0-9 ]{1,80}?", "some one").replace("[a-z0-9 ]{1,60}?", "some one").replace("[a-z0-9 ]{1,30}?", "some one").replace("[a-z]+", "ool").replace("[sc]", "c")
    while "(?:" in text:
        text = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] else m[1].split("|")[0], text)
    return re.sub(r".\?", "", text)


def test_every_rule_runs_behind_its_words():
    """Scanner against plain scan on a text for each rule, on versions in short, and on pieces of these texts mixed up."""
    scanner, rng = licenses.Scanner(), random.Random(5)
    texts = ["MPL 2.0", "EPL-2.0", "CDDL 1.0", "EUPL 1.2", "Artistic 2.0", "SSPL version 1", "AFL 3.0", "Creative Commons Attribution 4.0", "GNU Lesser General Public v 2.1", "Freebsd licence", "python software foundation 2", "GPLv2 GPL v3", "This file is licensed under the GPLv2"]
    want = ["mpl-2.0", "epl-2.0", "cddl-1.0", "eupl-1.2", "artistic-2.0", "sspl-1.0", "afl-3.0", "cc-by-4.0"]
    assert [scanner.scan(t.encode())[5] for t in texts[: len(want)]] == want
    own = [spelled(pattern.pattern.removeprefix(" ").removesuffix("(?= )")) for _, pattern in ALL]
    for (r, pattern), t in zip(ALL, own, strict=True):
        assert pattern.search(f" {t} "), (r.label, t)
        assert r.all_of or r.any_of
    mixed = [" ".join(rng.choice(own)[rng.randrange(4) :] for _ in range(6)) for _ in range(60)]
    for t in texts + own + mixed:
        assert [tuple(m.values()) for m in scanner.scan(t.encode())[7]] == scanned_plainly(t), t


def test_license_texts_without_a_name():
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")"
    assert licenses.Scanner().scan(text.encode())[5] == "mit"
    text = "# This Source Code Form is subject to the terms of the Mozilla Public\n License, v. 2.0."
    assert licenses.Scanner().scan(text.encode())[5] == "mpl-2.0"
    assert licenses.Scanner().scan(b"a clean text about software, free of any charge or notice")[5:] == ("", 0.0, [])


def test_one_repeated_phrase_is_linear():
    scanner = licenses.Scanner()
    n = 40_000
    t0 = time.perf_counter()
    words, places, first, last, *_, marks = scanner.scan(b"Under the MIT License " * n)
    assert (words, places, first, last, len(marks)) == (4 * n, n, 0, 4 * n - 4, n) and time.perf_counter() - t0 < 20
