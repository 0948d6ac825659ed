"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import decontam, dialogue, lexical, licenses, linededup, neardup, packing, pii, quality, secret_scan, topk, url_filter, warc
from ripplegraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query(
    "op9_line_dedup",
    """
    with d as (select doc_id, text, coalesce(source, '') as host, string_split(text, chr(10)) as ls from documents),
    l as (select rowid_, host, unnest(list_distinct([trim(x) for x in ls if trim(x) <> ''])) as line
          from (select *, row_number() over () as rowid_ from d)),
    n as (select host, line, count(*) as pages from l group by 1, 2),
    t as (select host, count(*) as host_pages from d group by 1),
    b as (select host, list(line) as drop_ from n join t using (host) where pages >= 3 and pages > 0.1 * host_pages group by 1),
    k as (select doc_id, host, text, ls, case when drop_ is null then ls else [x for x in ls if trim(x) = '' or not list_contains(drop_, trim(x))] end as kept
          from d left join b using (host))
    select doc_id, host, coalesce(len(ls), 0)::int as n_lines, coalesce(len(ls) - len(kept), 0)::int as n_dropped,
           case when len(kept) < len(ls) then array_to_string(kept, chr(10)) else text end as text
    from k
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.dedup_lines(docs, host="source").select("doc_id", F.coalesce("source", F.lit("")).alias("host"), "n_lines", "n_dropped", "text")


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.withColumn("n_detections", F.size("detections")).drop("detections")


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", 0, _ASSIGN), ("access", 1, "AKIA[A-Z0-9]{16,}"), ("hex", 2, "[0-9a-f]{24,}"), ("opaque", 4, "[A-Za-z0-9+/_-]{24,}"))
_HITS = " union all ".join(f"select doc_id, owner, repo, '{k}' as kind, {o} as ord, regexp_extract_all(t, '{p}') as ms, string_split_regex(t, '{p}') as gs from d" for k, o, p in _KINDS)


@query(
    "op1_secret_scan",
    f"""
    with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as owner, concat_ws('/', source, lang) as repo from documents),
    h as ({_HITS}),
    s as (select doc_id, owner, repo, kind, ord, ms[i] as hit, (list_sum([length(x) for x in gs[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0))::bigint as start
          from (select *, unnest(range(1, len(ms) + 1)) as i from h)),
    e as (select *, start + length(hit) as stop, case when kind = 'assign' then regexp_extract(hit, '{_ASSIGN}', 1) else hit end as val from s),
    base as (select * from e where kind in ('access', 'hex') or kind = 'assign' and length(val) >= 6),
    loose as (select * from e where kind = 'opaque' and regexp_matches(hit, '[A-Z]') and regexp_matches(hit, '[a-z]') and regexp_matches(hit, '[0-9]')
              and not exists (select 1 from base b where b.doc_id = e.doc_id and b.start < e.stop and e.start < b.stop)),
    cand as (select doc_id, owner, repo, 'live' as kind, 3 as ord, stop - length(val) as start, stop, val from base union all select doc_id, owner, repo, kind, ord, start, stop, val from loose),
    own as (select val, count(distinct owner) as n_owners, count(distinct (owner, repo)) as n_repos from cand group by 1),
    judged as (select *, len(list_distinct(string_split(val, ''))) >= 8 and regexp_matches(val, '[A-Za-z]') and regexp_matches(val, '[0-9]')
                 and not regexp_matches(val, '(?i)example|sample|dummy|placeholder|changeme|your[_-]|redacted|x{{4,}}|[*]{{3,}}|123456|abcdef')
                 and len([c for c in list_distinct(string_split(lower(val), '')) if contains(lower(val), repeat(c, 6))]) = 0 as live
               from cand join own using (val)),
    added as (select distinct doc_id, start, ord, stop, kind from judged where n_owners <= 2 and n_repos <= 3 and live),
    spans as (select doc_id, start, ord, stop, kind from base union all select * from added)
    select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(b, '')) as base_sha256,
           coalesce(sp, '') as spans, coalesce(n_owned, 0)::bigint as n_owned, coalesce(n_copied, 0)::bigint as n_copied, coalesce(most, 0)::bigint as most_owners, coalesce(repos, 0)::bigint as most_repos
    from d
    left join (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
                 string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord, stop) as b from base group by 1) using (doc_id)
    left join (select doc_id, string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord, stop) as sp from spans group by 1) using (doc_id)
    left join (select doc_id, count(*) as n_owned from added group by 1) using (doc_id)
    left join (select doc_id, count(distinct val) filter (where n_owners > 2 or n_repos > 3) as n_copied, max(n_owners) as most, max(n_repos) as repos from judged group by 1) using (doc_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repo"))
    return secret_scan.digest_columns(secret_scan.scan_secrets(docs))


_PII = (
    ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len([p for p in string_split(hit, '.') if coalesce(try_cast(p as hugeint), 999) > 255]) = 0"),
    ("card", 2, r"[0-9](?:[\x20-]?[0-9]){12,}", "length(digits) between 13 and 19 and luhn % 10 = 0"),
    ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 9 and 15"),
)
_PII_HITS = " union all ".join(f"select u, '{k}' as kind, {o} as ord, regexp_extract_all(t, '{p}') as ms, string_split_regex(t, '{p}') as gs from uq" for k, o, p, _ in _PII)
_PII_VALID = " or ".join(f"kind = '{k}' and {v}" for k, _, _, v in _PII)
_PLACE = "(list_sum([length(x) for x in gs[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0))::bigint"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKEN = rf"{_PII[0][2]}|[\p{{L}}\p{{M}}]+"


@query(
    "op5_pii",
    f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    uq as (select row_number() over () as u, t from (select distinct t from d)),
    h as ({_PII_HITS}),
    s as (select u, kind, ord, ms[i] as hit, {_PLACE} as start from (select *, unnest(range(1, len(ms) + 1)) as i from h)),
    g as (select *, start + length(hit) as stop, regexp_replace(hit, '[^0-9]', '', 'g') as digits from s),
    v as (select *, list_sum([case when (length(digits) - j) % 2 = 0 then digits[j]::int else (digits[j]::int * 2) % 10 + digits[j]::int // 5 end for j in range(1, length(digits) + 1)]) as luhn from g),
    base as (select u, kind, ord, hit, start, stop from v where {_PII_VALID}),
    wl as (select u, regexp_extract_all(x, '{_TOKEN}') as ms, string_split_regex(x, '{_TOKEN}') as gs from (select u, {_LOWER.format("t")} as x from uq)),
    wi as (select u, generate_subscripts(ms, 1) as i, unnest(ms) as hit, unnest(gs[:-2]) as gap from wl where len(ms) > 0),
    wp as (select u, hit as term, (sum(length(gap) + length(hit)) over (partition by u order by i) - length(hit))::bigint as start from wi),
    w as (select u, term, start, start + length(term) as stop from wp where not contains(term, '@')),
    ut as (select distinct u, term from w),
    terms as (select term, count(*) as n_term from ut group by 1),
    uv as (select distinct u, kind || ':' || hit as val from base),
    vals as (select val, count(*) as n_value from uv group by 1),
    joint as (select val, term, count(*) as n_both from uv join ut using (u) group by 1, 2 having count(*) >= 2),
    scored as (select term, max(1 + log2(least(n_both / n_term, 1.0)) / -log2(least(n_value / n_all, 0.5))) as reveal
               from joint join terms using (term) join vals using (val), (select count(*) as n_all from uq) group by 1 having reveal >= 0.8),
    marks as (select w.u, start, stop, reveal from w join scored using (term) where not exists (select 1 from base b where b.u = w.u and b.start < w.stop and w.start < b.stop)),
    spans as (select u, ord, start, stop, kind from base union all select u, case when reveal >= 0.95 then 4 else 5 end, start, stop, case when reveal >= 0.95 then 'reveal' else 'hint' end from marks),
    o as (select u, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone,
        count(*) filter (where ord >= 4) as n_terms, string_agg(kind || ':' || start || ':' || stop, ',' order by ord, start, stop) filter (where ord < 4) as b,
        string_agg(kind || ':' || start || ':' || stop, ',' order by ord, start, stop) as sp from spans group by 1)
    select doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip, coalesce(n_card, 0)::bigint as n_card, coalesce(n_phone, 0)::bigint as n_phone,
           sha256(coalesce(b, '')) as base_sha256, coalesce(sp, '') as spans, coalesce(n_terms, 0)::bigint as n_terms
    from d join uq using (t) left join o using (u)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_pii(table(spark, sf_dir, "documents")))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(
    "op8_warc",
    """
    with p as (select page_id, coalesce(html, '') as h from pages),
    q as (select page_id, octet_length(encode(h)) as n, sha256(h) as digest from p),
    f as (select digest, min(page_id) as first_id from q where n >= 100 group by 1)
    select page_id, n::bigint as payload_bytes, digest as payload_digest,
           case when n >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
           case when n >= 100 and page_id > first_id then first_id end as refers_to
    from q left join f using (digest)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(spark, warc.write_pages(table(spark, sf_dir, "pages")))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op7_decontamination",
    """
    with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
    win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
            from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0)),
    ns as (select distinct n from win),
    g as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
          from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
    hit as (select doc_id, i, n, item_id from g join win using (n, g)),
    places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
    named as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, cast(item_id as varchar) as x from hit) group by 1)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
           sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join places using (doc_id) left join named using (doc_id)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query(
    "op6_exact_top_k",
    """
    with v as (select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
               where embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    s as (select q.vec_id as query_id, p.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.v, p.v)])::bigint as score
          from v q, v p where q.vec_id % 50 = 0 and q.vec_id <> p.vec_id and len(q.v) = len(p.v))
    select query_id, rank::int as rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


@query(
    "op4_minhash_near_dedup",
    r"""
    with recursive t as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
    s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
          from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from t where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by 1),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
    link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
    both_ways as (select a, b from link union all select b, a from link),
    reach as (select doc_id as a, doc_id as b from t union select r.a, e.b from reach r join both_ways e on e.a = r.b)
    select doc_id, coalesce(n.n, 0)::bigint as n_shingles, m as component_id, m = doc_id as kept
    from t left join n using (doc_id) join (select a as doc_id, min(b) as m from reach group by 1) using (doc_id)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_SUFFIX = rf"(?:^|\.)((?:{'|'.join(url_filter.SECOND_LEVEL)})\.[a-z]{{2}}|[^.]*)$"


def _shrink(name: str, above: str, n: str, k: str, m: str, v: str, s: str, level: int) -> str:
    """SQL of one level: mean and variance after k of n below a rate of mean m and variance v."""
    weight = f"case when {m} * (1 - {m}) > 0 then {m} * (1 - {m}) / ({m} * (1 - {m}) / ({s} + 1) + {v} * ({s} / ({s} + 1))) - 1 else {s} end"
    return f"""{name}_w as (select {above}.*, {weight} as w{level} from {above}, s),
    {name}_m as (select *, ({k} + w{level} * {m}) / ({n} + w{level}) as m{level} from {name}_w),
    {name} as (select *, m{level} * (1 - m{level}) / ({n} + w{level} + 1) as v{level} from {name}_m)"""


@query(
    "op11_url_filter",
    rf"""
    with rules (verdict, host, path) as (values {", ".join(f"('{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in _RULES)}),
    u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
    lab as (select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where quality is not null or toxic is not null group by 1),
    cnt as (select host, count(*) as n, sum(bad) as k from (select distinct page_id, host from u) join lab using (page_id) group by 1),
    nm as (select host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') as name from (select distinct host from u)),
    sx as (select host, name, regexp_matches(name, '^\[|^[0-9.]*$') as addr, case when regexp_matches(name, '^\[|^[0-9.]*$') then '' else regexp_extract(name, '{_SUFFIX}', 1) end as suffix from nm),
    hs as (select host, case when addr then name else regexp_extract(left(name, length(name) - length(suffix)), '([^.]*\.)$', 1) || suffix end as domain, suffix,
                  coalesce(n, 0)::hugeint as n, coalesce(k, 0)::hugeint as k from sx left join cnt using (host)),
    ds as (select domain, suffix, sum(n)::hugeint as n, sum(k)::hugeint as k from hs group by 1, 2),
    ss as (select suffix, sum(n)::hugeint as n, sum(k)::hugeint as k from ds group by 1),
    t as (select sum(n)::hugeint as n, sum(k)::hugeint as k, coalesce(sum(k)::double / nullif(sum(n)::double, 0), 0) as m from ss),
    sq as (select 1 as lvl, sum(n * n)::hugeint as nn, sum(k * (n - k))::hugeint as mx from ss union all select 2, sum(n * n), sum(k * (n - k)) from ds union all select 3, sum(n * n), sum(k * (n - k)) from hs
           union all select 0, n * n, k * (n - k) from t),
    ab as (select a.lvl, a.mx::double / nullif(a.nn - t.n, 0)::double as same, (p.mx - a.mx)::double / nullif(p.nn - a.nn, 0)::double as apart from sq a join sq p on p.lvl = a.lvl - 1, t),
    st as (select lvl, least(greatest(coalesce(case when apart > same then same / (apart - same) end, 1000), 2), 1000)::double as s from ab),
    s as (select max(s) filter (where lvl = 1) as s1, max(s) filter (where lvl = 2) as s2, max(s) filter (where lvl = 3) as s3 from st),
    c1 as (select hs.host, hs.domain, hs.n::bigint as n, hs.k::bigint as k, (ds.n - hs.n)::bigint as nd, (ds.k - hs.k)::bigint as kd, (ss.n - ds.n)::bigint as ns, (ss.k - ds.k)::bigint as ks, t.m as m0
           from hs join ds on ds.domain = hs.domain and ds.suffix = hs.suffix join ss on ss.suffix = hs.suffix, t),
    {_shrink("c2", "c1", "ns", "ks", "m0", "0::double", "s1", 1)}, {_shrink("c3", "c2", "nd", "kd", "m1", "v1", "s2", 2)}, {_shrink("b0", "c3", "n", "k", "m2", "v2", "s3", 3)},
    b as (select host, domain, n, k, m3 - 1.645::double * sqrt(v3) as bound from b0),
    r as (select page_id, u.host, u.path, arg_max(struct_pack(rule := rules.host || rules.path, verdict := verdict), length(rules.host || rules.path)) as hit
          from (select distinct page_id, host, path from u) u join rules on (u.host = rules.host or ends_with(u.host, '.' || rules.host)) and starts_with(u.path, rules.path) group by 1, 2, 3)
    select u.page_id, u.host, u.path, hit.rule as rule, coalesce(hit.verdict, case when bound > 0.5 then 'block' else 'allow' end) as verdict,
           b.domain, b.n::bigint as labelled, b.k::bigint as bad
    from u join b using (host) left join r on r.page_id = u.page_id and r.host = u.host and r.path = u.path
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, else the host's reputation; the labels name their page by its id and call it bad when its quality is 0 or it is toxic."""
    labels = table(spark, sf_dir, "labels").filter("quality is not null or toxic is not null")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, _RULES).drop("mean", "bound")


_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '{lexical.TERM}')"


@query(
    "op12_lexical_search",
    rf"""
    with b as (select distinct item_id, unnest({_WORDS}) as term from benchmark where item_id is not null),
    d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
    c as (select count(*) as n_docs, sum(len(w))::bigint as total from d where len(w) > 0),
    v as (select distinct term from b),
    tf as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) semi join v using (term) group by 1, 2),
    df as (select term, count(*) as df from tf group by 1),
    wt as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double)) as bigint) as w from df, c),
    m as (select r, doc_id, 50 + (50 * len(w)::bigint * n_docs) // total as m from d, c where len(w) > 0 and doc_id is not null),
    s as (select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from b join tf using (term) join wt using (term) join m using (r) group by 1, 2, 3)
    select item_id, rank::int as rank, doc_id, score
    from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_STEPS = "(0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)"


@query(
    "op13_conversation_repair",
    rf"""
    with recursive tb as (select list(c order by i) as tbl from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
    raw as (select conv_id, coalesce('=' || conv_id, '') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint) as bytes from conversations),
    hit as (select *, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind from raw, tb),
    dam as (select conv, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                   unnest(range(case when kind = 3 then 2 else 1 end)) as copy from hit where kind <> 0),
    o as (select *, row_number() over (partition by conv order by turn nulls first, role, sha256(text), copy) as i, left(role, 1) as init, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from dam),
    f as (select *, bare = '' as blank, bare <> '' and row_number() over (partition by conv, role, text order by i) > 1 as dup, right(bare, 1) not in ('.', '!', '?') as cut,
                 lag(init) over (partition by conv order by i) as before from o),
    step (f, sym, t) as (values {_STEPS}),
    role_of (sym, name) as (values ('u', 'user'), ('a', 'assistant')),
    q as (select f as state, f as t, '' as pre, []::varchar[] as ins from step union all select f, t, 'I', [name] from step join role_of using (sym)
          union all select a.f, b.t, 'II', [x.name, y.name] from step a join step b on b.f = a.t join role_of x on x.sym = a.sym join role_of y on y.sym = b.sym),
    moves as (select state, t, pre || 'D' as letters, ins, null as need, null as name, 3 + 2 * length(pre) as cost from q
              union all select q.state, s.t, pre || 'K', ins, s.sym, '', 2 * length(pre) from q join step s on s.f = q.t
              union all select 0, 1, 'K', [], 's', '', 0
              union all select q.state, s.t, pre || 'R', ins, null, r.name, 2 + 2 * length(pre) from q join step s on s.f = q.t join role_of r using (sym)),
    p as (select conv, 0::bigint as i, 0 as state, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as best from (select distinct conv from dam)
          union all
          select p.conv, p.i + 1, m.t, min({{'cost': p.best.cost + m.cost + case when f.cut and m.name is not null then 1 else 0 end, 'audit': p.best.audit || m.letters,
                 'lines': list_concat(p.best.lines, list_concat([x || ':' for x in m.ins], case when m.name is null then [] when m.name = '' then [f.role || ':' || f.text] else [m.name || ':' || f.text] end))}})
          from p join f on f.conv = p.conv and f.i = p.i + 1 join moves m on m.state = p.state and (m.need is null or m.need = f.init) and (m.name is null or not (f.blank or f.dup))
          group by p.conv, p.i + 1, m.t),
    n as (select conv, count(*) as n, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (where blank) as blank, count(*) filter (where dup) as duplicate,
                 count(*) filter (where cut and not blank and not dup) as truncated, count(*) filter (where i > 1 and before || init not in ('su', 'ua', 'au')) as illegal from f group by 1),
    e as (select p.conv, min({{'cost': best.cost + 2 * length(q.pre), 'audit': best.audit || q.pre, 'lines': list_concat(best.lines, [x || ':' for x in q.ins])}}) as best
          from p join n on n.conv = p.conv and n.n = p.i join q on q.state = p.state and q.t in (0, 3) group by 1)
    select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
           coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id, conv from raw) left join n using (conv) left join e using (conv)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(table(spark, sf_dir, "conversations"))
