"""Company, country and sanction registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.text import lookup_column
from ripplegraph.operators.common import top_k
from ripplegraph.sources.staging import Batch, connection, entity, union

# Schemas of the landed files.
LEI_L1 = (
    "LEI string, `Entity.LegalName` string, `Entity.LegalJurisdiction` string, `Entity.EntityStatus` string, `Entity.EntityCategory` string, "
    "`Entity.LegalForm.OtherLegalForm` string, `Entity.LegalAddress.City` string, `Registration.InitialRegistrationDate` string"
)
LEI_L2 = (
    "`Relationship.StartNode.NodeID` string, `Relationship.EndNode.NodeID` string, `Relationship.RelationshipType` string, "
    "`Relationship.RelationshipStatus` string"
)
SANCTIONS = (
    "id string, schema string, datasets array<string>, first_seen string, last_seen string, properties struct<name:array<string>,"
    "birthDate:array<string>,nationality:array<string>,position:array<string>,topics:array<string>,country:array<string>>"
)
SPARQL = "results struct<bindings:array<map<string,struct<value:string>>>>"

# Sanction schema -> entity type, and the two tiers of datasets.
SANCTION_TYPES = {
    "Person": "Person", "Company": "Corporation", "Organization": "LegalEntity", "LegalEntity": "LegalEntity", "PublicBody": "LegalEntity",
}
TIER_ONE = ("us_ofac_sdn", "eu_fsf", "un_sc_sanctions")
TIER_TWO = ("interpol_red_notices", "us_bis_denied")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def lei_entities(l1: DataFrame) -> Batch:
    """Company rows and ``registered_in`` edges to the country before the dash of the jurisdiction."""
    name, jur = _q("Entity.LegalName"), _q("Entity.LegalJurisdiction")
    x = l1.filter((F.trim("LEI") != "") & (F.trim(name) != "")).withColumn("country", F.element_at(F.split(jur, "-"), 1))
    ent = entity(
        x, "company", name, "GLEIF", 0.97, lei=F.col("LEI"), jurisdiction=jur, country=F.col("country"), status=_q("Entity.EntityStatus"),
        category=_q("Entity.EntityCategory"), legal_form=_q("Entity.LegalForm.OtherLegalForm"), city=_q("Entity.LegalAddress.City"),
        registered=_q("Registration.InitialRegistrationDate"),
    )
    return Batch(ent, connection(x, "company", name, "registered_in", "country", F.col("country"), "GLEIF", 0.99, causal_weight=0.1, mechanism="jurisdiction"))


def lei_ownership(l2: DataFrame, l1: DataFrame) -> DataFrame:
    """Active ownership edges, both ends resolved to legal names through their LEI."""
    child, parent = _q("Relationship.StartNode.NodeID"), _q("Relationship.EndNode.NodeID")
    kind = _q("Relationship.RelationshipType")
    rel = F.when(kind == "IS_DIRECTLY_CONSOLIDATED_BY", "subsidiary_of").otherwise("owned_by")
    x = l2.filter(_q("Relationship.RelationshipStatus") == "ACTIVE").select(child.alias("c"), parent.alias("p"), rel.alias("relation"))
    names = l1.select("LEI", _q("Entity.LegalName").alias("legal"))
    x = x.join(names.select(F.col("LEI").alias("c"), F.col("legal").alias("cn")), "c", "left").join(
        names.select(F.col("LEI").alias("p"), F.col("legal").alias("pn")), "p", "left"
    )
    return connection(
        x, "company", F.coalesce("cn", "c"), F.col("relation"), "company", F.coalesce("pn", "p"), "GLEIF", 0.97, causal_weight=0.6,
        mechanism="ownership_chain", child_lei=F.col("c"), parent_lei=F.col("p"),
    )


def sparql_rows(landed: DataFrame, fields: list[str], label: str) -> DataFrame:
    """One row per binding; blank labels and labels that are bare item ids (``Q…``) are dropped."""
    b = landed.select(F.explode("results.bindings").alias("b"))
    rows = b.select(*[F.trim(F.element_at("b", f)["value"]).alias(f) for f in fields])
    return rows.filter((F.coalesce(label, F.lit("")) != "") & ~F.startswith(F.col(label), F.lit("Q")))


def item_id(uri: str) -> Column:
    """Last segment of an item URI."""
    return F.element_at(F.split(F.col(uri), "/"), -1)


def sparql_countries(landed: DataFrame) -> Batch:
    x = sparql_rows(landed, ["country", "countryLabel", "iso2", "iso3", "capitalLabel", "population", "continentLabel"], "countryLabel")
    ent = entity(
        x, "country", F.col("countryLabel"), "Wikidata", 0.95, wikidata_qid=item_id("country"), iso2=F.col("iso2"), iso3=F.col("iso3"),
        capital=F.col("capitalLabel"), population=F.col("population"), continent=F.col("continentLabel"),
    )
    return Batch(ent, connection(x, "country", F.col("countryLabel"), "located_in", "country", F.col("continentLabel"), "Wikidata", 0.99))


def sparql_leaders(landed: DataFrame) -> Batch:
    """Heads of state and of government in one pass; the role is the property the row came from."""
    x = sparql_rows(landed, ["person", "personLabel", "countryLabel", "role"], "personLabel").filter(F.coalesce("countryLabel", F.lit("")) != "")
    role = F.when(item_id("role") == "P6", "head_of_government").otherwise("head_of_state")
    ent = entity(x, "person", F.col("personLabel"), "Wikidata", 0.9, wikidata_qid=item_id("person"), role=role, country=F.col("countryLabel"))
    return Batch(ent, connection(x, "person", F.col("personLabel"), role, "country", F.col("countryLabel"), "Wikidata", 0.9, causal_weight=0.7))


def sparql_central_banks(landed: DataFrame) -> Batch:
    x = sparql_rows(landed, ["bank", "bankLabel", "countryLabel"], "bankLabel")
    ent = entity(x, "central_bank", F.col("bankLabel"), "Wikidata", 0.95, wikidata_qid=item_id("bank"), country=F.col("countryLabel"))
    return Batch(ent, connection(x, "central_bank", F.col("bankLabel"), "central_bank_of", "country", F.col("countryLabel"), "Wikidata", 0.97))


def organisations(members: DataFrame, cap: int | None = None) -> Batch:
    """members(org, qid, member) -> one row per organisation with its member count, and its
    membership edges: all, or the first ``cap`` in name order."""
    m = members.select("org", "qid", "member").distinct()
    org = m.groupBy("org").agg(F.min("qid").alias("qid"), F.count(F.lit(1)).alias("n"))
    ent = entity(org, "regional_bloc", F.col("org"), "Wikidata", 0.95, wikidata_qid=F.col("qid"), member_count=F.col("n"))
    kept = m if cap is None else top_k(m, ["org"], [F.col("member")], cap)
    return Batch(ent, connection(kept, "regional_bloc", F.col("org"), "member_of", "country", F.col("member"), "Wikidata", 0.92))


def sanctions(rows: DataFrame) -> Batch:
    """Typed sanction targets; confidence by dataset tier, ISO-2 countries and held positions as edges."""
    p = "properties"
    x = (
        rows.withColumn("etype", lookup_column(SANCTION_TYPES, F.col("schema")))
        .withColumn("n", F.get(F.col(f"{p}.name"), F.lit(0))).filter(F.col("etype").isNotNull() & (F.coalesce("n", F.lit("")) != ""))
    )
    tier = lambda ds: F.arrays_overlap("datasets", F.array(*[F.lit(d) for d in ds]))
    conf = F.when(tier(TIER_ONE), 0.95).when(tier(TIER_TWO), 0.90).otherwise(0.80)
    ent = entity(
        x, F.col("etype"), F.col("n"), "opensanctions", conf, opensanctions_id=F.col("id"), datasets=F.array_join("datasets", ","),
        birth_date=F.get(F.col(f"{p}.birthDate"), F.lit(0)), nationality=F.array_join(f"{p}.nationality", ","), topics=F.array_join(f"{p}.topics", ","),
        first_seen=F.col("first_seen"), last_seen=F.col("last_seen"),
    )
    at = x.select("etype", "n", F.explode(f"{p}.country").alias("c")).filter(F.length("c") == 2)
    job = x.select("etype", "n", F.explode(f"{p}.position").alias("r"))
    con = union(
        connection(at, F.col("etype"), F.col("n"), "located_in", "Jurisdiction", F.upper("c"), "opensanctions"),
        connection(job, F.col("etype"), F.col("n"), "holds_role", "LegalEntity", F.col("r"), "opensanctions", role=F.col("r")),
    )
    return Batch(ent, con)


def tickers(landed: DataFrame) -> Batch:
    """An object of objects (body JSON text) -> companies with ten-digit CIK and their jurisdiction."""
    m = F.from_json("body", "map<string,struct<cik_str:string,ticker:string,title:string>>")
    x = landed.select(F.explode(m).alias("k", "v")).select("v.*")
    ent = entity(x, "Corporation", F.col("title"), "sec_edgar", 0.95, cik=F.lpad("cik_str", 10, "0"), ticker=F.col("ticker"), exchange="US", sec_registered="true")
    return Batch(ent, connection(x, "Corporation", F.col("title"), "has_jurisdiction", "Jurisdiction", "United States", "sec_edgar", registration="SEC"))


WORLDBANK = (
    "array<struct<id:string,iso2Code:string,name:string,region:struct<value:string>,incomeLevel:struct<value:string>,"
    "capitalCity:string,longitude:string,latitude:string>>"
)


def worldbank_countries(landed: DataFrame) -> Batch:
    """[meta, rows] JSON text -> countries without aggregates, capitals, regions."""
    x = landed.select(F.explode(F.from_json(F.get_json_object("body", "$[1]"), WORLDBANK)).alias("c")).select("c.*")
    x = x.filter((F.coalesce(F.col("region.value"), F.lit("")) != "Aggregates") & (F.coalesce("name", F.lit("")) != ""))
    country = entity(
        x, "Jurisdiction", F.col("name"), "worldbank", 0.95, iso2=F.col("iso2Code"), iso3=F.col("id"), region=F.col("region.value"),
        income_level=F.col("incomeLevel.value"), capital=F.col("capitalCity"), longitude=F.col("longitude"), latitude=F.col("latitude"),
    )
    capital = entity(x, "Location", F.col("capitalCity"), "worldbank", type="capital_city")
    con = union(
        connection(x, "Location", F.col("capitalCity"), "located_in", "Jurisdiction", F.col("name"), "worldbank", role="capital"),
        connection(x, "Jurisdiction", F.col("name"), "part_of", "Location", F.col("region.value"), "worldbank"),
    )
    return Batch(union(country, capital), con)


COUNTRY = (
    "name struct<common:string,official:string>, cca2 string, cca3 string, population bigint, region string, subregion string, capital array<string>, "
    "languages map<string,string>, currencies map<string,struct<name:string,symbol:string>>, borders array<string>, unMember boolean"
)


def country_facts(c: DataFrame) -> Batch:
    """Countries, capitals, regions, currencies; borders resolved from ISO-3 code to name."""
    c = c.withColumn("n", F.col("name.common")).filter(F.coalesce("n", F.lit("")) != "")
    caps = c.select("n", F.explode("capital").alias("x"))
    money = c.select("n", F.explode("currencies").alias("code", "m")).withColumn("x", F.coalesce("m.name", "code"))
    src, sub = "restcountries", c.filter(F.coalesce("subregion", F.lit("")) != "")
    codes = c.select(F.col("cca3").alias("code"), F.col("n").alias("other"))
    border = c.select("n", F.explode("borders").alias("code")).join(codes, "code", "left")
    ent = union(
        entity(
            c, "Jurisdiction", F.col("n"), src, 0.95, official_name=F.col("name.official"), iso2=F.col("cca2"), iso3=F.col("cca3"),
            population=F.col("population"), region=F.col("region"), subregion=F.col("subregion"), capital=F.get("capital", F.lit(0)),
            languages=F.array_join(F.map_values("languages"), ","), currencies=F.array_join(F.map_keys("currencies"), ","), un_member=F.col("unMember"),
        ),
        entity(caps, "Location", F.col("x"), src, type="capital_city", country=F.col("n")),
        entity(c.select("region").distinct(), "Location", F.col("region"), src, type="continent_region"),
        entity(sub.select("subregion", "region").distinct(), "Location", F.col("subregion"), src, type="subregion", parent_region=F.col("region")),
        entity(money.select("x", "code").distinct(), "FinancialInstrument", F.col("x"), src, code=F.col("code"), type="currency"),
    )
    con = union(
        connection(caps, "Location", F.col("x"), "located_in", "Jurisdiction", F.col("n"), src, role="capital"),
        connection(c, "Jurisdiction", F.col("n"), "part_of", "Location", F.col("region"), src),
        connection(sub, "Jurisdiction", F.col("n"), "part_of", "Location", F.col("subregion"), src),
        connection(border, "Jurisdiction", F.col("n"), "related_to", "Jurisdiction", F.coalesce("other", "code"), src, type="shares_border"),
        connection(money, "Jurisdiction", F.col("n"), "issues", "FinancialInstrument", F.col("x"), src, type="national_currency"),
    )
    return Batch(ent, con)


def latest_by_country(values: DataFrame, countries: int | None = None) -> DataFrame:
    """values(indicator, values map<country, map<year, value>>) -> ``impacts`` edges with the latest
    year of each country; with ``countries``, of the first so many of an indicator."""
    x = values.select("indicator", F.explode("values").alias("country", "years")).select("indicator", "country", F.explode("years").alias("year", "value"))
    last = x.groupBy("indicator", "country").agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))
    if countries is not None:
        last = top_k(last, ["indicator"], [F.col("country")], countries)
    return connection(last, "Indicator", F.col("indicator"), "impacts", "Jurisdiction", F.col("country"), "imf", year=F.col("year"), value=F.col("value"), unit="percent")


def indicator_values(rows: DataFrame, source: str, unit: str) -> Batch:
    """rows(indicator, code, country, value, year) -> indicator nodes and ``impacts`` edges."""
    x = rows.filter(F.col("country").isNotNull() & F.col("value").isNotNull() & (F.col("value") != 0))
    ent = entity(x.select("indicator", "code").distinct(), "Indicator", F.col("indicator"), source, wb_code=F.col("code"))
    return Batch(ent, connection(x, "Indicator", F.col("indicator"), "impacts", "Jurisdiction", F.col("country"), source, value=F.col("value"), year=F.col("year"), unit=unit))


REPO = "name string, html_url string, stargazers_count bigint, language string, description string, owner struct<login:string,type:string,html_url:string>"


def repositories(r: DataFrame) -> Batch:
    """Repository and owner nodes; organisations own, people founded."""
    org = F.col("owner.type") == "Organization"
    otype = F.when(org, "Corporation").otherwise("Person")
    ent = union(
        entity(
            r, "Technology", F.col("name"), "github", 0.85, github_url=F.col("html_url"), stars=F.col("stargazers_count"), language=F.col("language"),
            description=F.col("description"),
        ),
        entity(r, otype, F.col("owner.login"), "github", type=F.when(org, "tech_company").otherwise("developer")),
    )
    rel = F.when(org, "owns").otherwise("founded_by")
    return Batch(ent, connection(r, otype, F.col("owner.login"), rel, "Technology", F.col("name"), "github", platform="github"))


def curated_edges(rows: DataFrame, prefix: str = "connection_policy", confidence: float = 0.95) -> DataFrame:
    """Curated list rows(category, from_type, from_name, relation, to_type, to_name) -> connections."""
    return connection(
        rows, F.col("from_type"), F.col("from_name"), F.col("relation"), F.col("to_type"), F.col("to_name"),
        F.concat(F.lit(prefix + ":"), F.col("category")), confidence,
    )


def regional_hierarchy(rows: DataFrame) -> Batch:
    """rows(country, subregion, region) -> distinct places and nested ``part_of`` edges."""
    sub, reg = rows.select("subregion", "region").distinct(), rows.select("region").distinct()
    ent = union(
        entity(rows, "Jurisdiction", F.col("country"), "static", 0.95), entity(sub, "Location", F.col("subregion"), "static", 0.95),
        entity(reg, "Location", F.col("region"), "static", 0.95),
    )
    con = union(
        connection(rows, "Jurisdiction", F.col("country"), "part_of", "Location", F.col("subregion"), "static", 0.95),
        connection(sub, "Location", F.col("subregion"), "part_of", "Location", F.col("region"), "static", 0.95),
    )
    return Batch(ent, con)
