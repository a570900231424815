"""Ages, freshness classes and kickoff windows; "now" is always given, never the wall clock."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes until a feed's record is aging, and until it is stale.
FEED_THRESHOLDS = (
    ("schedule", 1440, 4320),
    ("roster", 720, 2880),
    ("depthChart", 1440, 4320),
    ("injury", 360, 1440),
    ("weather", 180, 720),
    ("odds", 30, 120),
    ("manualPrice", 30, 60),
)
#: Freshness classes from best to worst.
SEVERITY = ("CURRENT", "AGING", "STALE", "CONFLICTING", "MISSING")


def age_minutes(at: Column, now: Column) -> Column:
    """Minutes from ``at`` to ``now``; NULL for a text that is no time."""
    micros = lambda c: F.unix_micros(c.try_cast("timestamp"))
    return (micros(now) - micros(at)) / 6e7


def classify_freshness(at: Column, now: Column, aging: Column | float, stale: Column | float, conflict: Column | bool = False) -> Column:
    """A conflict, an unreadable time or one after now is CONFLICTING, no time is MISSING, else by age (bounds included)."""
    age = age_minutes(at, now)
    conflict = conflict if isinstance(conflict, Column) else F.lit(conflict)
    return (
        F.when(F.coalesce(conflict, F.lit(False)), "CONFLICTING")
        .when(at.isNull(), "MISSING")
        .when((age < 0) | at.try_cast("timestamp").isNull(), "CONFLICTING")
        .when(age <= aging, "CURRENT")
        .when(age <= stale, "AGING")
        .otherwise("STALE")
    )


def feed_freshness(feed: Column, at: Column, now: Column) -> Column:
    """Class of a feed's record by the feed's own thresholds; NULL for an unknown feed."""
    out = F.lit(None).cast("string")
    for name, aging, stale in FEED_THRESHOLDS:
        out = F.when(feed == name, classify_freshness(at, now, aging, stale)).otherwise(out)
    return out


def severity(status: Column) -> Column:
    out = F.when(status == SEVERITY[0], 0)
    for i, s in enumerate(SEVERITY[1:], 1):
        out = out.when(status == s, i)
    return out


def worst_freshness(status: Column) -> Column:
    """Aggregate: the worst class of a group; CURRENT for an empty one."""
    return F.element_at(F.array(*map(F.lit, SEVERITY)), F.coalesce(F.max(severity(status)), F.lit(0)) + 1)


def kickoff_window(at: Column) -> Column:
    """By UTC weekday and hour: Friday, Monday and Tuesday are prime time, else early or late."""
    return F.when(F.dayofweek(at).isin(6, 2, 3), "PRIMETIME").when(F.hour(at) < 19, "SUN_EARLY").otherwise("SUN_LATE")


def minutes_before(at: Column, minutes: Column | int) -> Column:
    return at - F.make_interval(mins=minutes if isinstance(minutes, Column) else F.lit(minutes))


def format_utc(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm'Z'")


def known_zone(zone: Column) -> Column:
    """The zone, or UTC if it is missing or no zone that the system knows."""
    return F.when(zone.isin(*sorted(zoneinfo.available_timezones())), zone).otherwise("UTC")


def format_kickoff(at: Column, zone: Column | str) -> Column:
    """Local time in a zone; UTC in an unknown one."""
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    return F.date_format(F.from_utc_timestamp(at, known_zone(zone)), "EEE, MMM d, h:mm a")


def format_ago(at: Column, now: Column) -> Column:
    minutes = F.floor(age_minutes(at, now) + 0.5).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.format_string("%dm ago", minutes))
        .when(hours < 48, F.format_string("%dh %dm ago", hours, minutes % 60))
        .otherwise(F.format_string("%dd ago", F.floor(hours / 24).cast("long")))
    )


def age_tier(minutes: Column, first: float, second: float, names: tuple[str, str, str] = ("ok", "warn", "bad")) -> Column:
    return F.when(minutes <= first, names[0]).when(minutes <= second, names[1]).otherwise(names[2])
