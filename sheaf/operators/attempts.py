"""From attempts and captured content to one outcome per publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.payload import redirect_target, valid_pdf
from sheaf.functions.urls import ARXIV, ELSEVIER, STANDARD, WILEY
from sheaf.operators.dedup import first_by
from sheaf.session import durable, lookup_side

# Outcomes, and how many redirects are followed.
SUCCESS, FAIL, ERROR = "success", "fail", "error"
MAX_REDIRECTS = 5
FOUND, DEAD_END, STILL_OPEN = "pdf", "dead end", "open"
CHANNELS = [ARXIV, WILEY, ELSEVIER, STANDARD]


def first_success(
    attempts: DataFrame,
    key: Sequence[str],
    order_by: Sequence[str],
    ok: str = "ok",
    harvester: str = "channel",
    url: str = "url",
) -> DataFrame:
    """One row per key: the first successful attempt, or a failure with empty harvester and URL.

    A single aggregation; every task sends one row per key, however many attempts a key has.
    """
    done = F.min_by(
        F.when(F.col(ok), F.struct(F.col(harvester).alias("h"), F.col(url).alias("u"))),
        F.when(F.col(ok), F.struct(*order_by)),
    )
    return (
        attempts.groupBy(*key)
        .agg(done.alias("__first"))
        .select(
            *key,
            F.when(F.col("__first").isNotNull(), SUCCESS).otherwise(FAIL).alias("result"),
            F.coalesce(F.col("__first.h"), F.lit("")).alias("harvester_used"),
            F.coalesce(F.col("__first.u"), F.lit("")).alias("url_used"),
        )
    )


def step_codes(steps: DataFrame, captured: DataFrame) -> DataFrame:
    """Per publication, as numbers: ``first_code``, null without success, and ``last_rank``.

    ``first_code`` is eight times the rank of the first URL that succeeded, plus twice the place of its
    channel in ``CHANNELS``, plus one if its file is valid. The least code of a publication is kept in a
    hash aggregate, whatever its URLs are.
    """
    valid = F.col("valid_file") if "valid_file" in captured.columns else F.lit(True)
    # Outcome and validity as one small number. A URL captured twice in one channel counts by its
    # better outcome.
    better = F.when(F.col("outcome") == SUCCESS, 4).when(F.col("outcome") == FAIL, 2).when(F.col("outcome") == ERROR, 0)
    code = better + F.when(valid, 1).otherwise(0)
    by_url = captured.groupBy("url").agg(
        *[F.max(F.when(F.col("channel") == c, code)).alias(f"by_{c}") for c in CHANNELS]
    )
    own = F.coalesce(*[F.when(F.col("channel") == c, F.col(f"by_{c}")) for c in CHANNELS])
    place = F.coalesce(*[F.when(F.col("channel") == c, F.lit(k)) for k, c in enumerate(CHANNELS)])
    plain = F.col(f"by_{STANDARD}")
    outcome = F.when(own >= 4, 2 * place + (own - 4)).when(
        # No outcome of the channel's own is a failure; an error skips the second attempt.
        (F.coalesce(own, F.lit(2)) >= 2) & (plain >= 4),
        2 * CHANNELS.index(STANDARD) + (plain - 4),
    )
    tried = steps.join(lookup_side(by_url), "url", "left").withColumn("__out", outcome)
    return tried.groupBy("id").agg(
        F.min(8 * F.col("url_rank") + F.col("__out")).alias("first_code"), F.max("url_rank").alias("last_rank")
    )


def resolve_steps(steps: DataFrame, captured: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Outcome of each publication, from its URL steps and the captured ``(url, channel, outcome)``.

    Each URL takes its own channel, then ``standard``; an error of the channel skips that second
    attempt, and a capture that is missing is a failure. Outcomes of one URL are brought into one
    row first, so a step needs one join. ``valid_file`` in the capture, when there, tells whether
    the stored file is a PDF. URLs are looked up by rank: in ``urls`` of ``manifest(id, urls)``, whose
    other columns are then kept, or in the steps themselves.
    """
    codes = step_codes(steps, captured)
    first = F.floor(F.col("first_code") / 8)
    if manifest is None:
        by_rank = steps.select("id", F.col("url_rank").alias("__rank"), "url")
        codes = codes.withColumn("__first", first)
        won = by_rank.withColumnRenamed("__rank", "__first").withColumnRenamed("url", "__won")
        last = by_rank.withColumnRenamed("__rank", "last_rank").withColumnRenamed("url", "last_url")
        found = codes.join(won, ["id", "__first"], "left").join(last, ["id", "last_rank"], "left")
        kept = []
    else:
        at = lambda rank: F.get("urls", (rank - 1).cast("int"))
        found = manifest.join(codes, "id").withColumn("__won", at(first)).withColumn("last_url", at(F.col("last_rank")))
        kept = [c for c in manifest.columns if c not in ("id", "urls")]
    rest = F.pmod("first_code", F.lit(8))
    channels = F.array(*map(F.lit, CHANNELS))
    return found.select(
        "id",
        *kept,
        F.when(F.col("first_code").isNotNull(), SUCCESS).otherwise(FAIL).alias("result"),
        F.coalesce(F.get(channels, F.floor(rest / 2).cast("int")), F.lit("")).alias("harvester_used"),
        F.coalesce("__won", F.lit("")).alias("url_used"),
        F.coalesce(rest % 2 == 1, F.lit(False)).alias("valid_fulltext_pdf"),
        "last_url",
    )


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successes, failures): success needs the download and a valid file."""
    good = (F.col("result") == SUCCESS) & F.col("valid_fulltext_pdf")
    good = F.coalesce(good, F.lit(False))
    return outcomes.where(good), outcomes.where(~good)


def resolve_urls(captured: DataFrame, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """Follow page redirects inside the captured ``(page_id, url, content)``.

    The first capture of a URL counts. With a column ``status_code``, only pages with 200 are read.
    Gives ``(url, final_url, hops, reason)`` for each URL: ``pdf`` where it leads to one in at most
    ``max_redirects`` steps, ``dead end`` where the last page has no redirect or was not captured, and
    ``open`` where more redirects would follow; ``final_url`` is how far it got. Pages are parsed once
    into a narrow table; only the chains still open take part in the next step, and each step is a join
    on a unique URL. Runs a job for each step while the plan is being made.
    """
    answered = F.col("status_code") == 200 if "status_code" in captured.columns else F.lit(True)
    content = F.when(answered, F.col("content"))
    is_pdf = valid_pdf(content)
    # Parsed before the exchange of the dedup, so that only narrow rows are sent; PDFs are not parsed.
    pages = captured.select(
        "url", "page_id", is_pdf.alias("is_pdf"), redirect_target(F.when(~is_pdf, content)).alias("next_url")
    )
    pages = durable(first_by(pages, ["url"], ["page_id"]).drop("page_id"), "pages")
    target = pages.select(
        F.col("url").alias("final_url"), F.col("is_pdf").alias("__pdf"), F.col("next_url").alias("__next")
    )

    def ended(reached: DataFrame, hops: int) -> DataFrame:
        found = F.coalesce("__pdf", F.lit(False))
        return reached.where(found | F.col("__next").isNull()).select(
            "url", "final_url", F.lit(hops).alias("hops"), F.when(found, FOUND).otherwise(DEAD_END).alias("reason")
        )

    reached = pages.select("url", F.col("url").alias("final_url"), F.col("is_pdf").alias("__pdf"), F.col("next_url").alias("__next"))
    done = ended(reached, 0)
    for hop in range(1, max_redirects + 2):
        still_open = reached.where("not __pdf and __next is not null").select("url", F.col("__next").alias("final_url"))
        if hop > max_redirects:
            return done.unionByName(
                still_open.withColumn("hops", F.lit(max_redirects)).withColumn("reason", F.lit(STILL_OPEN))
            )
        if still_open.isEmpty():
            return done
        # Written, as each step is read for the chains that end and for those that go on; without
        # that every step would join all steps before it again.
        reached = durable(still_open.join(target, "final_url", "left"), "hop")
        done = done.unionByName(ended(reached, hop))
    return done


def resolve_fetches(plan: DataFrame, captured: DataFrame, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """Apply a fetch plan ``(id, attempt_no, url)`` to captured content: the first valid PDF wins."""
    found = resolve_urls(captured, max_redirects).where(F.col("reason") == FOUND).drop("reason")
    reached = lookup_side(found)
    tried = plan.join(reached, "url", "left").withColumn("__ok", F.col("final_url").isNotNull())
    first = F.min_by(
        F.when(F.col("__ok"), F.struct("url", "final_url", "hops")),
        F.when(F.col("__ok"), F.col("attempt_no")),
    )
    return (
        tried.groupBy("id")
        .agg(first.alias("__first"))
        .select(
            "id",
            F.when(F.col("__first").isNotNull(), SUCCESS).otherwise(FAIL).alias("result"),
            F.coalesce(F.col("__first.url"), F.lit("")).alias("url_used"),
            F.col("__first.final_url").alias("final_url"),
            F.col("__first.hops").alias("hops"),
        )
    )
