"""Filters and state rules evaluated against a given clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.functions import text as X
from vetloom.functions.identity import valid_slug
from vetloom.plans import scans


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def open_attempts(attempts: DataFrame, now: str) -> DataFrame:
    """Active attempts strictly before their expiry."""
    return attempts.filter((F.col("status") == "active") & (at(now) < F.col("expires_at")))


def attempt_status_at(ids: DataFrame, attempts: DataFrame, now: str) -> DataFrame:
    """Status of each asked id; an active attempt at or past its expiry is timed out."""
    status = (
        F.when(F.col("status").isNull(), "not_found")
        .when((F.col("status") == "active") & (at(now) >= F.col("expires_at")), "timed_out")
        .otherwise(F.col("status"))
    )
    return ids.join(attempts, "attempt_id", "left").select("attempt_id", status.alias("status_at"))


def close_overdue(attempts: DataFrame, now: str, batch: int | None = None) -> DataFrame:
    """Overdue active rows become timed out; ``batch`` closes only the oldest so many, as one sweep does."""
    overdue = (F.col("status") == "active") & (F.col("expires_at") <= at(now))
    if batch is not None:
        due = attempts.filter(overdue).orderBy("expires_at", "attempt_id").limit(batch)
        attempts = attempts.join(due.select("attempt_id", F.lit(True).alias("__due")), "attempt_id", "left")
        overdue = F.coalesce("__due", F.lit(False))
    return attempts.withColumns(
        {
            "closed_at": F.when(overdue, at(now)).otherwise(F.col("closed_at")),
            "status": F.when(overdue, "timed_out").otherwise(F.col("status")),
        }
    ).drop("__due")


def offer_state(offers: DataFrame, now: str) -> DataFrame:
    state = (
        F.when(F.col("status") != "active", "unavailable").when(F.col("expires_at") <= at(now), "expired").otherwise("ok")
    )
    return offers.withColumn("state", state)


def valid_invitation(invitations: DataFrame, definitions: DataFrame, now: str) -> DataFrame:
    """First failing rule per invitation, or ok."""
    joined = invitations.join(definitions, "definition_id", "left")
    verdict = (
        F.when(F.col("status") != "issued", "not issued")
        .when(F.col("expires_at") <= at(now), "expired")
        .when(~F.coalesce(F.col("published"), F.lit(False)) | F.col("version_id").isNull(), "not published")
        .when(F.col("intended_email").isNotNull() & (F.lower("intended_email") != F.col("email")), "other email")
        .otherwise("ok")
    )
    return joined.withColumn("verdict", verdict)


def search_rows(df: DataFrame, columns: Sequence[str], needle: str) -> DataFrame:
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(needle.strip().lower()))


def facet_filter(df: DataFrame, facet: str, value: str, everything: str = "all") -> DataFrame:
    return df if value == everything else df.filter(F.col(facet) == value)


def published_catalogue(definitions: DataFrame, versions: DataFrame, slug: str | None = None, n: int = 100) -> DataFrame:
    """Published definitions whose current version is published: one exact slug, or the first ``n`` by title."""
    live = versions.filter(F.col("published_at").isNotNull()).select("version_id")
    joined = definitions.filter("status = 'published'").join(live, "version_id")
    if slug is not None:
        return joined.filter(valid_slug(F.lit(slug)) & (F.col("slug") == slug))
    return joined.orderBy("title", "slug").limit(n)


def offer_access(offers: DataFrame, acceptances: DataFrame, now: str) -> DataFrame:
    """Open offers with an accepted undertaking; the others with the reason they stay shut."""
    accepted = acceptances.filter("accepted").groupBy("offer_id").agg(F.max("accepted_at").alias("accepted_at"))
    joined = offer_state(offers, now).join(accepted, "offer_id", "left")
    access = F.when(F.col("state") != "ok", F.col("state")).when(F.col("accepted_at").isNull(), "undertaking missing").otherwise("open")
    return joined.withColumn("access", access)


def known_events(events: DataFrame, types: Sequence[str], owner: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(list(types)) & F.col(owner).isNotNull())


def evidence_quote_found(df: DataFrame, source: str, quote: str) -> DataFrame:
    """Whether the folded quote occurs in the folded source; an empty quote never does."""
    folded = X.fold_text(F.col(quote))
    return df.withColumn("found", (folded != "") & X.fold_text(F.col(source)).contains(folded))


def recent_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Newest ``n`` rows; the order must end in a key so ties are stable."""
    return df.orderBy(*order).limit(n)


def audit_trail(events: DataFrame, attempt: str, ts: str, key: str, n: int = 300) -> DataFrame:
    """First ``n`` events per attempt by time, then by insertion."""
    return scans.first_rows(events, [attempt], [F.col(ts), F.col(key)], n, "position")


def notify_queue(results: DataFrame, attempts: DataFrame, retries: int = 5, n: int = 5) -> DataFrame:
    """Oldest unsent results of closed attempts with retries left."""
    closed = attempts.filter(F.col("status").isin("completed", "timed_out")).select("attempt_id")
    due = results.filter(F.col("notified_at").isNull() & (F.col("notify_attempts") < retries))
    return due.join(closed, "attempt_id", "left_semi").orderBy("graded_at", "attempt_id").limit(n)


def longest_first(names: DataFrame) -> DataFrame:
    """Dictionary order for matching: longer names first, then by name, with the position as a column."""
    size = F.length("name")
    # Lengths are few, so the order is a count per length plus a rank inside one length.
    # Names of one length are ranked in chunks of their first characters, so that a common length is spread.
    sized = names.withColumn("__size", size)
    longer = sized.groupBy("__size").agg(F.count("*").alias("__n"))
    before = Window.orderBy(F.col("__size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = longer.select("__size", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = scans.number_rows(sized, ["__size"], ["name"], F.substring("name", 1, 3), "__inside")
    ranked = inside.join(offsets, "__size")
    return ranked.withColumn("position", F.col("__before") + F.col("__inside")).drop("__size", "__n", "__inside", "__before")


def sort_study(rows: DataFrame, key: str, year: str, position: str) -> DataFrame:
    """Place of every study row in its record: newest year first, missing years last, ties as written."""
    keyed = rows.withColumn("__age", -F.coalesce(F.col(year), F.lit(0)))
    return scans.number_rows(keyed, [key], ["__age", position], F.col("__age"), "place").drop("__age")
