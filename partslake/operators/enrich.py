"""Part metadata: response cache with expiry, prefix fallback, first non-empty chain."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partslake.functions import rules as R

# Days an Active part's response stays good; other lifecycles never expire.
TTL_DAYS = 30

PAYLOAD = "struct<category_path: string, datasheet: string, package: string, lifecycle: string>"


def is_stale(now: Column, ttl_days: int = TTL_DAYS) -> Column:
    """``cached_at`` is epoch seconds."""
    age = F.unix_seconds(now) - F.col("cached_at")
    return (F.col("lifecycle") == "Active") & (age > ttl_days * 86400)


def cache_lookup(parts: DataFrame, cache: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Parts with the cached payload, null where there is none or it is stale."""
    fresh = cache.filter(~F.coalesce(is_stale(now, ttl_days), F.lit(False))).select(
        F.col("mpn").alias("part"), "payload_json", "lifecycle"
    )
    return parts.join(fresh, "part", "left").withColumn("hit", F.col("payload_json").isNotNull())


def expire_stale(cache: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Cache without stale Active rows; nothing else is ever removed."""
    return cache.filter(~F.coalesce(is_stale(now, ttl_days), F.lit(False)))


def cache_put(cache: DataFrame, responses: DataFrame, now: Column) -> DataFrame:
    """Cache with the answers fetched: the payload as it came, its lifecycle, and ``now``.

    ``responses`` as for :func:`enrich`; only status ok is kept. A part that is cached gets
    the new answer in place of the old; of several answers for a part one stays.
    """
    fetched = (
        responses.filter((F.col("status") == "ok") & F.col("mpn").isNotNull())
        .groupBy("mpn")
        .agg(F.max("payload_json").alias("payload_json"))
        .select(
            "mpn",
            "payload_json",
            F.from_json("payload_json", PAYLOAD)["lifecycle"].alias("lifecycle"),
            F.unix_seconds(now).alias("cached_at"),
        )
    )
    kept = cache.join(fetched.select("mpn"), "mpn", "left_anti")
    return kept.select(*fetched.columns).unionByName(fetched)


def family_datasheet(
    part: Column, prefixes: Sequence[tuple[str, str]] = R.DATASHEET_PREFIXES
) -> Column:
    """Datasheet of a part's family by prefix, longest first, null on a miss.

    ``x`` in a prefix stands for one digit.
    """
    ordered = sorted(prefixes, key=lambda p: (-len(p[0]), p[0]))
    pattern = lambda p: "(?i)^" + re.escape(p).replace("x", "[0-9]")
    return F.coalesce(*[F.when(part.rlike(pattern(p)), F.lit(url)) for p, url in ordered])


def enrich(
    parts: DataFrame,
    cache: DataFrame,
    responses: DataFrame,
    now: Column,
    online: bool = True,
    prefixes: Sequence[tuple[str, str]] = R.DATASHEET_PREFIXES,
) -> DataFrame:
    """Cache, then response, then prefix; a payload or the reason there is none.

    ``responses`` is ``(mpn, status, payload_json)`` with status ok / unknown / unreachable. Reasons:
    offline, network_unreachable, unknown_mpn (nobody knows it), fallback_missed (known,
    but no datasheet anywhere).
    """
    fresh = expire_stale(cache, now).select(F.col("mpn").alias("part"), "payload_json")
    answers = responses.select(
        F.col("mpn").alias("part"), "status", F.col("payload_json").alias("answer_json")
    )
    # both are unique by part, so they meet first, and the parts join once; a part with
    # many rows can then be split over tasks
    known = fresh.join(answers, "part", "full_outer")
    joined = parts.join(known, "part", "left").withColumn("hit", F.col("payload_json").isNotNull())
    asked = F.lit(online) & ~F.col("hit")
    status = F.when(asked, F.coalesce("status", F.lit("unknown")))
    payload = F.from_json(
        F.coalesce("payload_json", F.when(asked & (status == "ok"), F.col("answer_json"))), PAYLOAD
    )
    own = F.nullif(F.col("payload.datasheet"), F.lit(""))
    family = family_datasheet(F.col("part"), prefixes)
    work = (
        joined.withColumn("status", status)
        .withColumn("payload", payload)
        .withColumn("datasheet", F.coalesce(own, F.when(F.col("hit") | F.lit(online), family)))
        .withColumn(
            "reason",
            F.when(~F.col("hit") & ~F.lit(online), "offline")
            .when(F.col("status") == "unreachable", "network_unreachable")
            .when(F.col("datasheet").isNotNull(), None)
            .when(F.col("status") == "unknown", "unknown_mpn")
            .otherwise("fallback_missed"),
        )
    )
    ok = F.col("reason").isNull()
    return work.select(
        *parts.columns,
        F.when(ok, "enriched").otherwise("no_enrichment").alias("kind"),
        "reason",
        F.when(ok, F.when(F.col("hit"), "cache").when(F.col("status") == "ok", "response").otherwise("prefix")).alias("origin"),
        F.when(ok, F.col("datasheet")).alias("datasheet"),
        F.when(ok, F.col("payload")).alias("payload"),
    )


def enrichment_cells(enriched: DataFrame) -> DataFrame:
    """Description, Datasheet and Notes of enriched parts.

    Notes carry the package, and the lifecycle only if it is not Active.
    """
    p = F.col("payload")
    lifecycle = F.when(p["lifecycle"] != "Active", F.nullif(p["lifecycle"], F.lit("")))
    return enriched.filter(F.col("kind") == "enriched").select(
        "part",
        F.nullif(F.split(p["category_path"], "/")[0], F.lit("")).alias("description"),
        "datasheet",
        F.nullif(
            F.concat_ws("; ", F.nullif(p["package"], F.lit("")), lifecycle), F.lit("")
        ).alias("notes"),
    )


def enrichment_outcomes(log: DataFrame) -> DataFrame:
    """Outcomes per kind and day of the audit log ``(ts, kind)``."""
    return log.groupBy(F.to_date("ts").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))
