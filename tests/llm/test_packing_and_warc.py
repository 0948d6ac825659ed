"""Packing and archives: exact round trips."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegraph.llm import packing, warc
from tests.llm.conftest import EDGES, prose


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_files()[0])


ODD = ["a  b", " lead", "trail ", "tab\tx \n y", "no break x", "don't we'll I'M", "12 345 x1y2", "漢字 かな", "\U0001f600 ok", "<|endoftext|> x", "é è ê", "x\n\ny z", " em space", "a\x1cb c"]


def test_tokens_are_those_of_the_library(tokenizer):
    mine = packing.Tokens(*packing.tokenizer_files(), 50)
    for t in [*ODD, *ODD, prose(5, 300), *(r[1] or "" for r in EDGES if r[0] not in (9, 10, 11))]:
        assert mine.of(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:40]


def test_packing_is_whole_and_tight(make_docs, no_docs, tokenizer):
    rows = [r for r in EDGES if r[0] not in (9, 10, 11)] + [(100 + i, t, "en", "s") for i, t in enumerate(ODD)] + [(200 + i, prose(i, 5 + 13 * i % 700), "en", "s") for i in range(150)] + [(500 + i, "same words here", "en", "s") for i in range(100)]
    got = packing.pack_documents(make_docs(rows), with_ids=True).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, *_ in rows:
        if i is None or i == 4:
            continue
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, p in enumerate(sorted(pieces[i], key=lambda x: x["piece"])):
            part = ids[at : at + p["length"]].tobytes()
            assert (p["piece"], p["start"], p["ids_crc32"], bytes(p["ids"])) == (n, at, zlib.crc32(part), part) and (n == 0 or p["length"] == 2048)
            at += p["length"]
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(pieces[4]) == 2 and len(pieces[None]) == 2
    total = sum(r["length"] for r in got)
    assert len(seqs) <= -(-total // 2048) * 1.02 + 2
    whole = packing.sequences(packing.pack_documents(make_docs(rows[-40:]), with_ids=True)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert packing.pack_documents(no_docs).collect() == []


def test_plan_covers_every_rank_once():
    rng = random.Random(3)
    for cap in (10, 64, 2048):
        for _ in range(20):
            counts = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
            fill, seen = defaultdict(int), defaultdict(list)
            for s, r, n, q, o in packing.sweep_plan(counts, cap):
                for j in range(n):
                    seen[s].append(r + j)
                    assert fill[q + j] == o
                    fill[q + j] += s
                    assert fill[q + j] <= cap
            assert {s: sorted(x) for s, x in seen.items()} == {s: list(range(n)) for s, n in counts.items()}


PAGES = [
    (1, "http://a/", "<p>" + "same " * 40), (2, "http://b/", "<p>" + "same " * 40), (3, None, "<p>" + "same " * 40), (4, "http://c/\r\nX: y", "short"), (5, "http://d/é", "short"), (6, "http://e/", None), (7, "http://f/", ""),
    (None, "http://g/", "<p>" + "same " * 40), (8, "u", "WARC/1.1\r\n\r\n" + "x" * 300_000), (9, "u", "é" * 50), (10, "u", "é" * 49), (11, "u", "é" * 49), (0, "u", "é" * 50), (12, "u", "z" * 120), (12, "u", "z" * 120),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)


def wanted():
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = b in first and (i is None or i > first[b])
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def test_archive_round_trip(spark, pages):
    path = warc.write_pages(pages)
    assert sorted((tuple(r) for r in warc.read_pages(spark, path).collect()), key=repr) == wanted()
    all_records = warc.read_warc(spark, path)
    assert all_records.filter("warc_type = 'revisit' and payload is not null and length(payload) > 0").count() == 0
    near = warc.read_warc(spark, path, "record_id string, target_uri string").filter("target_uri like 'http://%' and record_id in ('<urn:page:1>', '<urn:page:4>')")
    assert {r["target_uri"] for r in near.collect()} == {"http://a/", "http://c/ X: y"}
    assert warc.read_warc(spark, warc.write_pages(pages.limit(0)), "record_id string").collect() == []


def test_plain_and_foreign_archives(spark, pages, tmp_path):
    plain = str(tmp_path / "plain")
    warc.register(spark)
    warc.plan_records(pages).write.format("warc").mode("append").option("compress", "false").option("file_bytes", 1000).save(plain)
    assert sorted((tuple(r) for r in warc.read_pages(spark, plain).collect()), key=repr) == wanted()
    rows = [{"warc_type": "response", "record_id": f"<urn:page:{i}>", "payload": b"p" * i} for i in range(5)]
    whole = gzip.compress(b"".join(warc.record_bytes(r, False) for r in rows))
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x.warc.gz").write_bytes(whole)
    assert sorted(len(r["payload"]) for r in warc.read_warc(spark, str(tmp_path / "foreign")).collect()) == [0, 1, 2, 3, 4]
    single = b"".join(warc.record_bytes(r, True) for r in rows)
    assert gzip.GzipFile(fileobj=io.BytesIO(single)).read() == b"".join(warc.record_bytes(r, False) for r in rows)


def test_unwanted_blocks_are_not_read():
    class File(io.BytesIO):
        got = 0

        def size(self):
            return len(self.getvalue())

        def read(self, n=-1):
            b = super().read(n)
            self.got += len(b)
            return b

    rng = random.Random(1)
    rows = [{"warc_type": t, "record_id": "r", "payload": rng.randbytes(200_000)} for t in ("response", "metadata", "response")]
    f = File(b"".join(warc.record_bytes(r, True) for r in rows))
    kept = list(warc.members(f, lambda h: h["warc-type"] == "metadata", True))
    assert len(kept) == 1 and len(kept[0][1]) == 200_000 and f.got < 230_000  # one block and three heads of a few kilobytes
