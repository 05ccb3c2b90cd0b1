"""Metadata filters of retrieval, and predicates on answers, audit rows and owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions import all_of, any_of, csv_list

# The filters known
EQUAL = ("document_slug", "version_hash", "center", "status", "docket_id", "communication_type", "regulated_product", "section_id")
LISTS = ("topics", "cfr_references", "product_codes")
DATES = ("issue_date_from", "issue_date_to")
KNOWN = (*EQUAL, "lifecycle_state", *LISTS, *DATES)
# Phrases that decide a matter of compliance
DECISIONS = (
    "you are compliant",
    "you are not compliant",
    "fda will approve",
    "submission will be accepted",
    "will be accepted by fda",
)


def clauses(filters: dict | None = None, topics_mode: str = "all") -> Column:
    """One predicate of all filters given; the lifecycle is active unless named; lists hold all, or any, of what is asked."""
    f = {k: v for k, v in (filters or {}).items() if v not in (None, "", [])}
    if unknown := sorted(set(f) - set(KNOWN)):
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    holds = {"all": all_of, "any": any_of}[topics_mode]
    parts = [F.col("lifecycle_state") == f.get("lifecycle_state", "active")]
    parts += [F.col(k) == f[k] for k in EQUAL if k in f]
    parts += [holds(F.col(k), list(f[k])) for k in LISTS if k in f]
    if "issue_date_from" in f:
        parts.append(F.col("issue_date") >= F.lit(f["issue_date_from"]).cast("date"))
    if "issue_date_to" in f:
        parts.append(F.col("issue_date") <= F.lit(f["issue_date_to"]).cast("date"))
    return reduce(lambda a, b: a & b, parts)


def normalize(queries: DataFrame, raw: str = "filters") -> DataFrame:
    """queries with used map<string,array<string>>, ignored (unknown keys, ascending) and route, from a map of raw filters."""
    m = F.coalesce(F.col(raw), F.create_map().cast("map<string,string>"))
    known = F.map_filter(m, lambda k, v: k.isin(*KNOWN) & v.isNotNull())
    used = F.transform_values(known, lambda k, v: F.when(k.isin(*LISTS), csv_list(v)).otherwise(F.array(v)))
    ignored = F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.isin(*KNOWN)))
    route = F.when(F.size(used) > 0, "metadata_constrained").otherwise("hybrid")
    return queries.select("*", used.alias("used"), ignored.alias("ignored"), route.alias("route"))


def decides_compliance(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\b(?:" + "|".join(DECISIONS) + r")\b"), F.lit(False))


def audit_filter(event_type=None, user_id=None, session_id=None, route=None, created_from=None, created_to=None) -> Column:
    """Equal fields and an inclusive range of times; what isn't given holds for every row."""
    given = {"event_type": event_type, "user_id": user_id, "session_id": session_id, "route": route}
    parts = [F.lit(True)] + [F.col(k) == v for k, v in given.items() if v is not None]
    if created_from is not None:
        parts.append(F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    if created_to is not None:
        parts.append(F.col("created_at") <= F.lit(created_to).cast("timestamp"))
    return reduce(lambda a, b: a & b, parts)


def with_status(status: str | None) -> Column:
    return F.lit(True) if status is None else F.col("status") == status


def visible_to(user_id: str, admin: bool = False) -> Column:
    """Rows of an owner; an administrator sees all."""
    return F.lit(True) if admin else F.col("user_id") == user_id


def issue_date(payload: Column) -> Column:
    return F.to_date(payload["issue_date"])
