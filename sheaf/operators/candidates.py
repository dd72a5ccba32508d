"""Candidate URLs of a publication: ranked locations, fetch plans and request schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.urls import FLAT_RULES, STANDARD, channel, rank_sql
from sheaf.operators.index import group_index, rank_within

# Requests allowed per window of seconds, by publisher client.
REQUEST_LIMITS = {"wiley": (1, 15), "elsevier": (1, 1)}


def rank_flat_locations(
    locations: DataFrame,
    key: Sequence[str],
    tie_break: Sequence[str],
    rules: Sequence[str] = FLAT_RULES,
    hot_rows: int = 1_000_000,
    counted: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Rank the PDF URLs of a flat location table inside each key; adds ``url_rank`` from 1.

    The relational twin of :func:`sheaf.functions.urls.ranked_locations`, for dumps stored as a
    publication table and a location table.
    """
    usable = locations.where(F.coalesce("url", F.lit("")) != "").withColumn(
        "__class", F.expr(rank_sql(rules))
    )
    ranked = rank_within(
        usable.where(F.col("__class").isNotNull()),
        key,
        ["__class", *tie_break],
        "url_rank",
        hot_rows,
        locations if counted is None else counted,
        sizes,
    )
    return ranked.withColumn("url_rank", F.col("url_rank") + 1).drop("__class")


def url_steps(manifest: DataFrame, wiley: bool = True, elsevier: bool = True) -> DataFrame:
    """One row per manifest URL, in order, with its channel: ``(id, doi, url_rank, url, channel)``."""
    # The outer form: the inner one adds a filter on the size of ``urls``, which is pushed down
    # with the whole ranking in it and ranks every record a second time.
    rows = manifest.select("id", "doi", F.posexplode_outer("urls").alias("pos", "url"))
    return rows.where(F.col("url").isNotNull()).select(
        "id",
        "doi",
        (F.col("pos") + 1).cast("bigint").alias("url_rank"),
        "url",
        channel(F.col("url"), wiley, elsevier).alias("channel"),
    )


def fallback_plan(steps: DataFrame) -> DataFrame:
    """Attempts in order: a special channel is followed by ``standard`` on the same URL.

    ``attempt_no`` is ``2 * url_rank`` for the channel's own attempt and one more for the
    fallback, so it orders the attempts of a publication without a window.
    """
    tries = F.when(
        F.col("channel") == STANDARD, F.array(F.struct(F.lit(1).alias("k"), F.lit(STANDARD).alias("channel")))
    ).otherwise(
        F.array(
            F.struct(F.lit(0).alias("k"), F.col("channel").alias("channel")),
            F.struct(F.lit(1).alias("k"), F.lit(STANDARD).alias("channel")),
        )
    )
    others = [c for c in steps.columns if c != "channel"]
    return steps.withColumn("__try", F.explode(tries)).select(
        *others,
        F.col("__try.channel").alias("channel"),
        (F.col("url_rank") * 2 + F.col("__try.k")).alias("attempt_no"),
    )


def throttle_schedule(
    requests: DataFrame,
    client: str,
    order_by: Sequence[str],
    start,
    limits: dict[str, tuple[int, int]],
    default: tuple[int, int] = (1, 1),
) -> DataFrame:
    """Earliest time of each request so that no client exceeds its limit per window.

    Adds ``slot`` (window number of the client, from 0) and ``not_before``. Clients are few and
    large, so their requests are numbered by :func:`group_index`, never by one task per client.
    """
    for requests_per_window, seconds in [*limits.values(), default]:
        if requests_per_window < 1 or seconds < 0:
            raise ValueError("a limit needs at least 1 request and a window of 0 s or more")

    def by_client(position: int):
        value = F.lit(default[position])
        for name, limit in limits.items():
            value = F.when(F.col(client) == name, F.lit(limit[position])).otherwise(value)
        return value

    numbered = group_index(requests, [client], order_by, "__n")
    slot = F.floor(F.col("__n") / by_client(0)).cast("bigint")
    first = F.unix_micros(F.lit(start).cast("timestamp"))
    return (
        numbered.withColumn("slot", slot)
        .withColumn("not_before", F.timestamp_micros(first + F.col("slot") * by_client(1) * 1_000_000))
        .drop("__n")
    )
