"""Deterministic identity.

Two profiles: ``sha256`` stays in native expressions and is the default; ``sha3`` gives the
dual-hash ids and needs the one Arrow UDF of the library, as SHA3 is not a Spark function.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed patterns of the canonical form.
SUFFIX = r",\s*(inc|llc|ltd|corp|co)\.?$"
NOT_KEPT = r"[^\w\s'-]"
US_NAMES = r"\b(us|usa|united states|america)\b"
UK_NAMES = r"\b(uk|gb|united kingdom|great britain)\b"
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trim_all(s: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def canonicalize(type_: Column, name: Column, compat: bool = True) -> Column:
    """``type:canonical name``.

    ``compat=True`` strips special characters before a domain is cut out of a URL, as existing
    ids do (so the URL rule never fires); ``compat=False`` cuts the host first.
    """
    raw = trim_all(F.lower(name))
    if not compat:
        host = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^https?://", ""), r"^www\.", ""), r"/.*$", "")
        raw = F.when(type_ == "Domain", host).otherwise(raw)
    s = F.regexp_replace(raw, SUFFIX, "")
    s = F.regexp_replace(s, f"{SPACE}+", " ")
    keep_dots = r"[^\w\s'.-]"
    plain = trim_all(F.regexp_replace(s, NOT_KEPT, ""))
    if compat:
        domain = F.regexp_replace(plain, r"^www\.", "")
    else:
        domain = trim_all(F.regexp_replace(s, keep_dots, ""))
    place = F.regexp_replace(F.regexp_replace(plain, US_NAMES, "united states"), UK_NAMES, "united kingdom")
    place = trim_all(F.regexp_replace(place, f"{SPACE}+", " "))
    canon = F.when(type_ == "Domain", domain).when(type_ == "Location", place).otherwise(plain)
    return F.concat(F.lower(type_), F.lit(":"), canon)


@F.pandas_udf(StringType())
def sha3_256(s: pd.Series) -> pd.Series:
    """Hex SHA3-256 of UTF-8 text."""
    return s.map(lambda v: None if v is None else hashlib.sha3_256(v.encode()).hexdigest())


def _primary(text: Column, profile: str) -> Column:
    if profile == "sha3":
        return sha3_256(text)
    if profile == "sha256":
        return F.sha2(text, 256)
    raise ValueError(f"unknown id profile {profile!r}")


def entity_id(type_: Column, name: Column, profile: str = "sha256", compat: bool = True) -> Column:
    """16 hex digits of the primary hash, ``:``, 12 hex digits of SHA-256, over the canonical form."""
    c = canonicalize(type_, name, compat)
    return F.concat(F.substring(_primary(c, profile), 1, 16), F.lit(":"), F.substring(F.sha2(c, 256), 1, 12))


def edge_id(from_id: Column, relation: Column, to_id: Column, profile: str = "sha256") -> Column:
    """C4"""
    return F.substring(_primary(F.concat_ws(":", from_id, relation, to_id), profile), 1, 16)


def claim_id(entity: Column, relation: Column, target: Column, profile: str = "sha256") -> Column:
    """C4"""
    return F.substring(_primary(F.concat_ws(":", F.lower(entity), relation, F.lower(target)), profile), 1, 16)


def legacy_id(id_: Column) -> Column:
    """The primary half of a composite id."""
    return F.element_at(F.split(id_, ":"), 1)


def parse_id(id_: Column) -> Column:
    """(primary, secondary), NULL unless there are exactly two parts."""
    p = F.split(id_, ":")
    return F.when(F.size(p) == 2, F.struct(F.element_at(p, 1).alias("primary"), F.element_at(p, 2).alias("secondary")))


def business_id(type_: Column, keys: Column) -> Column:
    """``type:k=v|k=v`` with the keys of a map in order."""
    e = F.array_sort(F.map_entries(keys))
    return F.concat(type_, F.lit(":"), F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|"))


def hash_pii(value: Column) -> Column:
    """C6"""
    return F.concat(F.lit("pii:"), F.substring(F.sha2(trim_all(F.lower(value)), 256), 1, 12))


def slug(prefix: str, value: Column) -> Column:
    """``prefix-some-name``."""
    return F.concat(F.lit(prefix + "-"), F.regexp_replace(F.regexp_replace(F.lower(value), r"\s+", "-"), "_", "-"))


def md5_id(prefix: str, value: Column, digits: int) -> Column:
    """``prefix-`` and the first digits of an MD5."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.md5(value), 1, digits))


def resolve_identity(incoming: DataFrame, known: DataFrame, profile: str = "sha256") -> DataFrame:
    """Id of every incoming (type, name) and whether the identity table lacks it."""
    x = incoming.withColumn("id", entity_id(F.col("type"), F.col("name"), profile))
    seen = known.select("id").distinct().withColumn("_seen", F.lit(True))
    return x.join(seen, "id", "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")
