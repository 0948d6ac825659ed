"""URL filter, lexical search and conversation repair against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from ripplegraph.llm import dialogue, lexical, url_filter
from tests.llm.conftest import prose

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))
PAGES = "page_id bigint, url string, host string, path string, verdict string, bad string, pages string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ---- URL filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return lower(host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def domain(host):
    name = host.rsplit("@", 1)[-1]
    name = re.sub(r":[0-9]*\Z", "", name)
    name = name[:-1] if name.endswith(".") else name
    if name.startswith("[") or not name.strip("0123456789."):
        return name, ""
    labels = name.split(".")
    n = 2 if len(labels) > 1 and re.fullmatch("[a-z]{2}", labels[-1]) and labels[-2] in url_filter.SECOND_LEVEL else 1
    return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])


def judged(pages, outcomes, rules, worst, z):
    """Verdicts by the formulas of the module, with dictionaries."""
    bad = {}
    for i, b in outcomes:
        if i is not None and b is not None:
            bad[i] = max(bad.get(i, False), b)
    hosts = {parts(u)[0]: [0, 0] for _, u in pages}
    for i, h in {(i, parts(u)[0]) for i, u in pages if i in bad}:
        hosts[h][0] += 1
        hosts[h][1] += bad[i]
    levels = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for h, (n, k) in hosts.items():
        for level, key in zip(levels, (domain(h)[1], domain(h), h), strict=True):
            level[0][key] += n
            level[1][key] += k
    n, k = sum(levels[0][0].values()), sum(levels[0][1].values())
    rate, pairs, mixed, strength = (k / n if n else 0.0), n * n, k * (n - k), []
    for own_n, own_k in levels:
        a, b = sum(x * x for x in own_n.values()), sum(own_k[x] * (own_n[x] - own_k[x]) for x in own_n)
        same = b / (a - n) if a > n else None
        apart = (mixed - b) / (pairs - a) if pairs > a else None
        strength.append(min(max(same / (apart - same), 2.0), 1000.0) if same is not None and apart is not None and apart > same else 1000.0)
        pairs, mixed = a, b
    out = []
    for i, u in pages:
        host, path = parts(u)
        mean, var, below = rate, 0.0, [domain(host)[1], domain(host), host]
        for j, s in enumerate(strength):  # a level without the host's part of it
            own, inner = levels[j], levels[j + 1] if j < 2 else None
            n_j = own[0][below[j]] - (inner[0][below[j + 1]] if inner else 0)
            k_j = own[1][below[j]] - (inner[1][below[j + 1]] if inner else 0)
            spread = mean * (1 - mean)
            weight = spread / (spread / (s + 1) + var * s / (s + 1)) - 1 if spread > 0 else s
            mean = (k_j + weight * mean) / (n_j + weight)
            var = mean * (1 - mean) / (n_j + weight + 1)
        bound = mean - z * math.sqrt(var)
        fits = [(len(t), t, v) for v, t in rules if (host == t[: t.index("/")] or host.endswith("." + t[: t.index("/")])) and path.startswith(t[t.index("/") :])]
        best = max(fits) if fits else (0, None, "block" if bound > worst else "allow")
        out.append((i, host, path, best[1], best[2], *hosts[host]))
    return sorted(out, key=repr)


ODD = [None, "", "no scheme", "http://", "http://A.Example.COM", "x://y://z/q", "http://www.example.com:80/en/a?b#c", "http://u@www.Example.com/en/", "https://10.0.0.1:8/x", "http://[::1]/x", "http://a.b.co.uk/p", "http://co.uk/p", "http://s.net/es", "http://s.net/es/1", "http://s.net./fr/?x", "http://\u00c9.org/#?" + "x" * 100_000, "http://q.com?/en/"]


@pytest.mark.parametrize("hot", [1000, 3])
def test_urls_against_dictionaries(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT", hot)
    rng = random.Random(hot)
    urls = [f"http://{rng.choice('ab')}{rng.randrange(4)}.{rng.choice(['spam', 'fine'])}.{rng.choice(['org', 'net', 'co.uk'])}/{rng.choice(['es', 'en'])}/{i}" for i in range(400)]
    pages = [(i, u) for i, u in enumerate(ODD + urls + ["http://hot.org/x"] * 200)] + [(None, "http://hot.org/y"), (3, "http://a.net/es/"), (3, "http://a.net/es/")]
    outcomes = [(i, rng.random() < (0.95 if ".spam." in (u or "") else 0.1)) for i, u in pages if rng.random() < 0.7] + [(None, True), (5, None), (7, True), (7, False), (9999, True)]
    df = spark.createDataFrame([(i, u, "h", "p", "v", "b", "n") for i, u in pages], PAGES).repartition(3)
    got = url_filter.judge(df, spark.createDataFrame(outcomes, "page_id bigint, bad boolean"), RULES)
    want = judged(pages, outcomes, RULES, url_filter.WORST, url_filter.Z)
    assert sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict", "labelled", "bad").collect()), key=repr) == want
    plain = [w for w in want if w[3] is None]
    spam = [w[4] == "block" for w in plain if ".spam." in w[1]]
    assert sum(spam) > 0.8 * len(spam) and all(w[4] == "allow" for w in plain if ".spam." not in w[1])
    kept = url_filter.keep_allowed(df, spark.createDataFrame(outcomes, "page_id bigint, bad boolean"), RULES)
    assert kept.count() == sum(w[4] == "allow" for w in want) and kept.columns == df.columns


def test_urls_need_evidence(spark):
    """One bad page does not block a host; an unseen host of a bad domain is blocked, without outcomes none is."""
    pages = [(i, f"http://h{i % 5}.bad.org/{i}") for i in range(100)] + [(100 + i, f"http://h{i}.good{i % 9}.org/") for i in range(100)] + [(300, "http://new.bad.org/"), (301, "http://one.org/")]
    outcomes = [(i, True) for i in range(100)] + [(100 + i, False) for i in range(100)] + [(301, True)]
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, spark.createDataFrame(outcomes, "page_id bigint, bad boolean"), ()).collect()}
    assert all(got[i] == "block" for i in [*range(100), 300]) and all(got[i] == "allow" for i in [*range(100, 200), 301])
    none = spark.createDataFrame([], "page_id bigint, bad boolean")
    assert {r["verdict"] for r in url_filter.judge(df, none, ()).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), none, RULES).collect() == []


# ---- lexical search


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))


def ranked(docs, items, k):
    words = [(i, Counter(terms(t))) for i, t in docs]
    words = [(i, c, sum(c.values())) for i, c in words if c]
    n_docs, total = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        rows = []
        for i, c, n in words:
            m = 50 + (50 * n * n_docs) // total
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0 and i is not None:
                rows.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def test_search_against_plain_scores(spark, make_docs):
    rng = random.Random(4)
    lexicon = prose(8, 300).split()
    docs = [(i, " ".join(rng.choices(lexicon, k=rng.choice([1, 3, 30, 200]))).title(), "en", "s") for i in range(150)]
    docs += [(900 + i, docs[3][1], "en", "s") for i in range(8)] + [docs[5], docs[5], (None, docs[4][1], "en", "s"), (500, None, None, None), (501, "", "en", "s"), (502, "_ [ ` {", "en", "s")]
    docs += [(503, " ".join(rng.choices(lexicon, k=40_000)), "en", "s"), (504, "x" * 3_000_000 + " " + lexicon[0], "en", "s"), (505, "\u00c9t\u00e9_" * 9, "en", "s")]
    items = [(i, " ".join(rng.choices(lexicon, k=rng.randrange(1, 12)))) for i in range(300)]
    items += [(7, lexicon[5]), (7, lexicon[6]), (None, lexicon[0]), (400, None), (401, ""), (402, "unseenword"), (403, " ".join(f"q{i}" for i in range(9000)) + " " + " ".join(lexicon)), (404, "\u00c9T\u00c9")]
    df = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id bigint, text string, score string")
    want = ranked([d[:2] for d in docs], items, 5)
    for block in (lexical.BLOCK, 1500):
        got = lexical.search(make_docs(docs), df, k=5, block=block)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert lexical.search(make_docs([]), df).collect() == [] and lexical.search(make_docs(docs), df.limit(0)).collect() == []
    assert lexical.search(make_docs([(1, None, None, None)]), df).collect() == []


def test_words_of_pieces():
    text = ("Ab_cd9 \u00e9\u00c9 " * 5000 + "z" * 9000).encode()
    for piece in (1, 7, 100, 10**6):
        assert [w for x in lexical.words_of(text, piece) for w in x] == [t.encode() for t in terms(text.decode())]


def test_partial_sums_are_exact():
    """The number of columns keeps every partial sum below 2**53, whatever the number of documents."""
    most = math.floor(1000 * math.log(2 * 10**13 + 2))
    assert lexical.TERMS * most * 10**6 < 2**53


# ---- conversation repair

SPACE = " \t\n\v\f\r"


def repaired(rows):
    """Counts, cost, audit and lines of (turn, role, text) rows: all edits, with whole audits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    nxt = {0: "u", 1: "u", 2: "a", 3: "u"}
    name = {"u": "user", "a": "assistant"}
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(tops):
        for _ in range(4):
            for s, (c, a, lines) in list(tops.items()):
                t = go[s, nxt[s]]
                tops[t] = min(tops.get(t, (10**9, "", [])), (c + 2, a + "I", lines + [name[nxt[s]] + ":"]))
        return tops

    tops, seen, n = {0: (0, "", [])}, set(), Counter()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        n[fault] += 1
        new = {}
        for s, (c, a, lines) in inserted(tops).items():
            ways = [(s, c + 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                ways += [(go[s, nxt[s]], c + 2, "R", [f"{name[nxt[s]]}:{text}"])]
                if (s, role[:1]) in go:
                    ways += [(go[s, role[:1]], c, "K", [f"{role}:{text}"])]
            for t, cost, letter, more in ways:
                new[t] = min(new.get(t, (10**9, "", [])), (cost, a + letter, lines + more))
        tops = new
    cost, audit, lines = min(v for s, v in inserted(tops).items() if s in (0, 3))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (kind != 0) * (2 if kind == 3 else 1)
    return out


def expected(rows, after):
    groups = {r[0]: [] for r in rows}
    for r in after:
        groups[r[0]].append(r[1:])
    return sorted(((c, *repaired(g)) for c, g in groups.items()), key=repr)


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([1, 2, 3, 6, 12])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No", " ", "Fine. \n", "", "why?\t", "\u00e9\u00e8!", None, "same.", f"t{turn}.", f"t{turn}"])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2), None if rng.random() < 0.03 else role, text))
    return rows


TALK = "conv_id bigint, turn bigint, role string, text string, cost string, part string, conv string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TALK).repartition(3)


def test_repair_against_whole_audits(spark):
    rows = talks(1, 150)
    rows += rows[:40]  # repeated rows
    rows += [(1000, i, ("user", "assistant")[i % 2], f"turn {i}." if i % 7 else "again") for i in range(1500)]  # one conversation over several ranges
    rows += [(1001, 5, "user", "copy.")] * 700 + [(1002, i, "assistant", "copy.") for i in range(500)] + [(1003, 0, "", "empty role."), (1004, 1, "user", "long " * 100_000), (1005, None, None, None)]
    got = dialogue.repair(frame(spark, rows), most=100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, damaged(rows))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = dialogue.repair(frame(spark, rows), damaged=None, most=10_000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, plain)
    assert dialogue.repair(frame(spark, rows).limit(0)).collect() == []


def test_stretches_join_to_the_whole_parse():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("suaut"), rng.random() < 0.15, rng.random() < 0.2, rng.choice([1, 1, 1, 3])) for _ in range(rng.randrange(0, 14))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(3))})
        pieces = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        whole = dialogue.chain([dialogue.transfer(rows)]) if rows else dialogue.chain([])
        cost, path, tail = dialogue.chain([dialogue.transfer(p) for p in pieces])
        letters = [x for p, (a, b) in zip(pieces, path, strict=True) for x in dialogue.letters_of(dialogue.parse(p, a)[b])]
        assert cost == whole[0] and tail == whole[2]
        if rows:
            assert letters == dialogue.letters_of(dialogue.parse(rows, 0)[whole[1][0][1]])
        texts = [(i, {"s": "system", "u": "user", "a": "assistant", "t": "tool"}[r[0]], f"{i}." if not r[2] else f"{i}") for i, r in enumerate(rows) if r[3] == 1 and not r[1]]
        if len(texts) == len(rows):
            assert repaired(texts)[5:7] == (cost, "".join(letters) + tail)


def test_repair_rows_stay_linear(spark):
    """A conversation with a third of all rows is dealt over ranges; each step has as many rows as there are turns."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(3000)] + [(2 + i // 4, i % 4, ("user", "assistant")[i % 2], f"{i}!") for i in range(6000)]
    named = frame(spark, rows).selectExpr("concat('=', conv_id) as conv", "turn", "role", "text", "1L as times")
    decisions, counts = dialogue.turns(named, most=500)
    assert decisions.count() <= len(rows) + 18 and counts.count() == 1501
    assert max(r["count"] for r in decisions.groupBy("part").count().collect()) < 2000
    assert decisions.filter("conv = '=1'").select("part").distinct().count() > 3
