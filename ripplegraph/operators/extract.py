"""Tool-output extraction into staged nodes and edges (S1, X-E1 to X-E8, I23, P7).

calls(call_id, tool, result): one row per tool call, ``result`` is JSON text.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.identity import hash_pii
from ripplegraph.functions.text import FIELD_TYPES, extract_domain, lookup_column, normalise_title, tool_name
from ripplegraph.session import materialize
from ripplegraph.sources.staging import Batch, connection, connection_row, connections, entities, entity, entity_row, union

LEAD = (
    "struct<company:string,organization:string,website:string,companyWebsite:string,company_size:string,companySize:string,industry:string,"
    "location:string,city:string,country:string,name:string,first_name:string,last_name:string,title:string,jobTitle:string,seniority:string,"
    "department:string,email:string>"
)
PERSON_CONFIDENCE, UNIVERSAL_CONFIDENCE, PAIR_CONFIDENCE = 0.7, 0.6, 0.5
#: The rule opens payloads five levels deep and takes field values of up to 200 characters.
MAX_DEPTH = 5


def _or(*cols: str) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def leads(calls: DataFrame) -> Batch:
    """X-E1: companies with industry, place, hashed person, job title and domain."""
    src = "tools/find-leads"
    rows = F.coalesce(F.from_json(F.get_json_object("result", "$.leads"), f"array<{LEAD}>"), F.from_json("result", f"array<{LEAD}>"))
    x = calls.select("call_id", F.explode(rows).alias("l")).select("call_id", "l.*")
    x = x.withColumn("firm", _or("company", "organization")).filter(F.col("firm").isNotNull())
    parts = F.concat_ws(", ", F.nullif(F.col("city"), F.lit("")), F.nullif(F.col("country"), F.lit("")))
    full = F.trim(F.concat_ws(" ", F.coalesce("first_name", F.lit("")), F.coalesce("last_name", F.lit(""))))
    x = (
        x.withColumn("place", F.coalesce(F.nullif(F.col("location"), F.lit("")), F.nullif(parts, F.lit(""))))
        .withColumn("who", F.coalesce(F.nullif(F.col("name"), F.lit("")), full)).withColumn("job", _or("title", "jobTitle"))
        .withColumn("site", extract_domain(_or("website", "companyWebsite", "email")))
    )
    x = x.withColumn("pii", F.when(F.length("who") > 1, hash_pii(F.col("who")))).withColumn(
        "job", F.when(F.col("pii").isNotNull(), normalise_title(F.col("job")))
    )
    firm = F.col("firm")
    ent = entities(
        x,
        entity_row("Company", firm, src, website=_or("website", "companyWebsite"), size=_or("company_size", "companySize"), industry=F.col("industry")),
        entity_row("Industry", F.col("industry"), src), entity_row("Location", F.col("place"), src),
        entity_row("Person", F.col("pii"), src, PERSON_CONFIDENCE, title=_or("title", "jobTitle"), seniority=F.col("seniority"), department=F.col("department")),
        entity_row("JobTitle", F.col("job"), src), entity_row("Domain", F.col("site"), src),
    )
    con = connections(
        x,
        connection_row("Company", firm, "operates_in", "Industry", F.col("industry"), src, 0.8),
        connection_row("Company", firm, "located_in", "Location", F.col("place"), src, 0.8),
        connection_row("Person", F.col("pii"), "works_at", "Company", firm, src, 0.8),
        connection_row("Person", F.col("pii"), "works_at", "JobTitle", F.col("job"), src, 0.8),
        connection_row("Company", firm, "has_domain", "Domain", F.col("site"), src, 0.8),
    )
    return Batch(ent, con)


def emails(calls: DataFrame) -> Batch:
    """X-E2: domain, organisation, address pattern and job titles."""
    src = "tools/find-emails"
    schema = "struct<domain:string,organization:string,pattern:string,emails:array<struct<position:string,department:string,seniority:string>>>"
    x = calls.select(F.from_json("result", schema).alias("r")).select("r.*").filter(F.coalesce("domain", F.lit("")) != "")
    org = F.nullif(F.col("organization"), F.lit(""))
    pattern = F.when(org.isNotNull(), F.col("pattern"))
    job = x.select(F.explode("emails").alias("e")).select("e.*").filter(F.coalesce("position", F.lit("")) != "")
    ent = union(
        entities(
            x, entity_row("Domain", F.col("domain"), src), entity_row("Company", org, src, 0.9, domain=F.col("domain")),
            entity_row("EmailPattern", pattern, src, 0.95, domain=F.col("domain")),
        ),
        entity(job, "JobTitle", normalise_title(F.col("position")), src, department=F.col("department"), seniority=F.col("seniority")),
    )
    con = connections(
        x, connection_row("Company", org, "has_domain", "Domain", F.col("domain"), src, 0.8),
        connection_row("Company", org, "has_email_pattern", "EmailPattern", pattern, src, 0.8),
    )
    return Batch(ent, con)


def company_info(calls: DataFrame) -> Batch:
    """X-E3: domain, company and one technology per social link."""
    src = "tools/get-company-info"
    schema = "struct<domain:string,website:struct<title:string,description:string,social_links:map<string,string>>,email_intelligence:struct<organization:string>>"
    x = calls.select(F.from_json("result", schema).alias("r")).select("r.*").filter(F.coalesce("domain", F.lit("")) != "")
    x = x.withColumn("org", F.nullif(F.col("email_intelligence.organization"), F.lit("")))
    tech = x.filter(F.col("org").isNotNull()).select("org", F.explode("website.social_links").alias("platform", "link")).filter(F.coalesce("link", F.lit("")) != "")
    ent = union(
        entities(
            x, entity_row("Domain", F.col("domain"), src),
            entity_row("Company", F.col("org"), src, 0.9, domain=F.col("domain"), title=F.col("website.title"), description=F.col("website.description")),
        ),
        entity(tech, "Technology", F.col("platform"), src, url=F.col("link")),
    )
    con = union(
        connection(x, "Company", F.col("org"), "has_domain", "Domain", F.col("domain"), src, 0.8),
        connection(tech, "Company", F.col("org"), "uses_technology", "Technology", F.col("platform"), src, 0.8),
    )
    return Batch(ent, con)


def local_leads(calls: DataFrame) -> Batch:
    """X-E4: companies of one keyword at one place; phone numbers are hashed."""
    src = "tools/find-local-leads"
    schema = "struct<keyword:string,location:string,leads:array<struct<name:string,address:string,phone:string,website:string,rating:string>>>"
    x = calls.select(F.from_json("result", schema).alias("r")).select("r.*").filter(F.coalesce("location", F.lit("")) != "")
    lead = x.select("keyword", "location", F.explode("leads").alias("l")).select("keyword", "location", "l.*").filter(F.coalesce("name", F.lit("")) != "")
    lead = lead.withColumn("site", extract_domain(F.nullif(F.col("website"), F.lit(""))))
    phone = hash_pii(F.nullif(F.col("phone"), F.lit("")))
    ent = union(
        entities(x, entity_row("Location", F.col("location"), src), entity_row("Industry", F.col("keyword"), src)),
        entities(
            lead, entity_row("Company", F.col("name"), src, 0.95, address=F.col("address"), phone=phone, website=F.col("website"), rating=F.col("rating")),
            entity_row("Domain", F.col("site"), src),
        ),
    )
    con = connections(
        lead, connection_row("Company", F.col("name"), "located_in", "Location", F.col("location"), src, 0.8),
        connection_row("Company", F.col("name"), "operates_in", "Industry", F.col("keyword"), src, 0.8),
        connection_row("Company", F.col("name"), "has_domain", "Domain", F.col("site"), src, 0.8),
    )
    return Batch(ent, con)


def web_results(calls: DataFrame) -> Batch:
    """X-E5: one domain per result with its title and snippet."""
    src = "tools/search-web"
    x = calls.select(F.explode(F.from_json(F.get_json_object("result", "$.results"), "array<struct<title:string,link:string,snippet:string>>")).alias("r")).select("r.*")
    ent = entity(x, "Domain", extract_domain(F.col("link")), src, title=F.col("title"), snippet=F.col("snippet"))
    none = connection(x.limit(0), "Domain", F.col("link"), "related_to", "Domain", F.col("link"), src)
    return Batch(ent, none)


def json_fields(calls: DataFrame, max_depth: int | None = None, longest: int | None = None) -> DataFrame:
    """X-E6: (call_id, tool, field, value, depth) for every string field whose name is mapped to a type.

    Objects are opened at most ``max_depth`` levels below the root (``None``: to the last one, written
    after each round); with ``longest``, longer values are no names.  Each round opens one layer of
    containers with ``variant_explode_outer`` and carries finished fields along, so a payload is
    parsed once and walked in one chain without shuffles.  A list in an object stays on its
    object's level and hands its items to the next one, hence two rounds per level.
    """
    spark = calls.sparkSession
    wanted = ", ".join(f"'{f}'" for f in FIELD_TYPES)
    x = calls.select(
        "call_id", "tool", F.try_parse_json("result").alias("v"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")
    )
    for _ in count() if max_depth is None else range(2 * max_depth + 1):
        opened = spark.sql(
            """SELECT t.call_id, t.tool, t.depth, t.field, t.value, t.v IS NOT NULL AS open, lower(k.key) AS key, k.value AS kv,
                 schema_of_variant(k.value) AS s, schema_of_variant(t.v) LIKE 'OBJECT%' AS in_object
               FROM {t} t, LATERAL variant_explode_outer(t.v) k""", t=x,
        )
        leaf = f"open AND in_object AND s = 'STRING' AND key IN ({wanted})"
        below = "CASE WHEN in_object AND s LIKE 'ARRAY%' THEN depth ELSE depth + 1 END"
        inner = f"open AND (s LIKE 'OBJECT%' OR s LIKE 'ARRAY%') {f'AND {below} <= {max_depth}' if max_depth is not None else ''}"
        x = opened.selectExpr(
            "call_id", "tool", f"CASE WHEN {inner} THEN kv END AS v", f"CASE WHEN {inner} THEN {below} ELSE depth END AS depth",
            f"CASE WHEN NOT open THEN field WHEN {leaf} THEN key END AS field",
            f"CASE WHEN NOT open THEN value WHEN {leaf} THEN variant_get(kv, '$', 'string') END AS value",
        ).filter("v IS NOT NULL OR field IS NOT NULL")
        if max_depth is None:
            x = materialize(x, "json-fields")
            if x.filter("v IS NOT NULL").isEmpty():
                break
    found = x.filter("field IS NOT NULL").drop("v")
    size = F.length("value")
    return found.withColumn("type", lookup_column(FIELD_TYPES, F.col("field"))).filter(size >= 2 if longest is None else size.between(2, longest))


def universal_nodes(calls: DataFrame, max_depth: int | None = None, longest: int | None = None) -> DataFrame:
    """X-E6: (call_id, tool, type, name, field) nodes of unknown tools' payloads."""
    clean = F.when(F.col("type") == "Domain", F.coalesce(extract_domain(F.col("value")), F.col("value"))).otherwise(F.trim("value"))
    return json_fields(calls, max_depth, longest).select("call_id", "tool", "type", clean.alias("name"), "field").filter(F.length("name") > 1)


def universal(calls: DataFrame, max_depth: int | None = None, longest: int | None = None) -> Batch:
    """X-E6 + I23: nodes of confidence .6, and ``related_to`` .5 between different types of one payload.

    Repeated mentions collapse first; the result is the set of edges itself, one per distinct
    pair of a single payload.
    """
    n = universal_nodes(calls, max_depth, longest)
    ent = entity(n, F.col("type"), F.col("name"), F.col("tool"), UNIVERSAL_CONFIDENCE, source_field=F.col("field"))
    one = n.select("call_id", "tool", "type", "name").distinct()
    other = one.select("call_id", F.col("type").alias("t2"), F.col("name").alias("n2"))
    pair = one.join(other, "call_id").filter(F.col("type") < F.col("t2"))
    return Batch(ent, connection(pair, F.col("type"), F.col("name"), "related_to", F.col("t2"), F.col("n2"), F.col("tool"), PAIR_CONFIDENCE))


EXTRACTORS: dict[str, Callable[[DataFrame], Batch]] = {
    "find_leads": leads, "find_emails": emails, "get_company_info": company_info, "find_local_leads": local_leads, "search_web": web_results,
}


def extract(calls: DataFrame, prefix: str = "", max_depth: int | None = None, longest: int | None = None) -> Batch:
    """Dispatch every call by its normalised tool name; unknown tools go to ``universal``."""
    x = calls.withColumn("_t", tool_name(F.col("tool"), prefix))
    parts = [f(x.filter(F.col("_t") == name)) for name, f in EXTRACTORS.items()]
    parts.append(universal(x.filter(~F.col("_t").isin(*EXTRACTORS)), max_depth, longest))
    return Batch(union(*[p.entities for p in parts]), union(*[p.connections for p in parts]))
