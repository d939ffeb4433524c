"""Figures and keys as text: token counts, quotes of cost, stamps, JSON within prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import DAY_MS, round_half_up

# The measured build from which costs are quoted in proportion.
BUILD_MOMENTS, BUILD_USD, BUILD_MINUTES, BUILD_MESSAGES = 5857, 0.25, 2.7, 5756


def token_text(n: Column) -> Column:
    """1.2M, 412k, 87."""
    millions = F.format_string("%.1fM", round_half_up(n / 1e6, 1))
    return F.when(n >= 1_000_000, millions).when(n >= 1000, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def quote_of_moments(n: Column) -> Column:
    """(moments, usd, minutes) of a build; what is no number or below zero counts as none."""
    moments = F.coalesce(F.greatest(F.lit(0), F.floor(F.nanvl(n.cast("double"), F.lit(0.0)))), F.lit(0)).cast("long")
    return F.struct(moments.alias("moments"), (moments * (BUILD_USD / BUILD_MOMENTS)).alias("usd"), (moments * (BUILD_MINUTES / BUILD_MOMENTS)).alias("minutes"))


def quote_of_messages(n: Column) -> Column:
    """The same from messages, of which each gives a little more than a moment."""
    return quote_of_moments(F.floor(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) * (BUILD_MOMENTS / BUILD_MESSAGES) + 0.5))


def quote_line(quote: Column) -> Column:
    usd, minutes = quote["usd"], quote["minutes"]
    dollars = F.when((usd > 0) & (usd < 0.005), "< $0.01").otherwise(F.format_string("~$%.2f", round_half_up(usd, 2)))
    time = F.when((minutes > 0) & (minutes < 1), "< 1 min").otherwise(F.format_string("~%d min", F.floor(minutes + 0.5)))
    return F.concat(F.lit("~"), F.format_number(quote["moments"], 0), F.lit(" moments · "), dollars, F.lit(" · "), time)


def minute_stamp(iso: Column) -> Column:
    """The minute of an ISO time, in UTC."""
    return F.concat(F.replace(F.substring(iso, 1, 16), F.lit("T"), F.lit(" ")), F.lit(" UTC"))


def first_json(text: Column) -> Column:
    """From the first brace of a text to the last, null if there is none or it is no JSON object."""
    found = F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit(""))
    return F.when(F.json_object_keys(found).isNotNull(), found)


def group_key(members: Column) -> Column:
    """One key for a set of (name, born_at), in whatever order."""
    return F.array_join(F.array_sort(F.transform(members, lambda m: F.concat(m["name"], F.lit("\0"), m["born_at"]))), "|")


def span_days(first_ms: Column, last_ms: Column) -> Column:
    """Days from the first to the last, both counted; none without times."""
    return F.coalesce(F.floor((last_ms - first_ms) / DAY_MS + 0.5) + 1, F.lit(0)).cast("long")


def same(a: Column, b: Column) -> Column:
    """Whether two structs or values are the same; two nulls are."""
    return a.eqNullSafe(b)
