"""Patches: proposals that stay open until trailing evidence heals, lapses or refutes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.numbers import DAY_MS
from .vectors import top_two

# When a patch of either mode changes its state.
SLIP_SAMPLE, GRADUATE, CLOSE, CLOSE_FACTOR = 100, 2, 2, 0.5
SLIP_FALSIFY, SLIP_FALSIFY_DAYS, SLIP_FALSIFY_FACTOR = 6, 42, 0.8
ASK_SAMPLE, LEARN, LEARN_FACTOR, ENGAGE_HOLD, LAPSE_DAYS = 30, 2, 0.5, 0.7, 42
ASK_FALSIFY, ASK_FALSIFY_DAYS, ASK_FALSIFY_FACTOR = 6, 42, 0.8
ANCHOR, MARGIN = 0.93, 0.02

ENTRY = "struct<built_ms:long,fail:double,sessions:int,sample:int,reach:int,hold:double,refused_rose:boolean,engage:double>"


def last_of(history: Column, n: int) -> Column:
    return F.slice(history, F.greatest(F.lit(1), F.size(history) - n + 1), F.lit(n))


def next_state(patches: DataFrame, now_ms: int) -> DataFrame:
    """patches with next_state and via.

    patches: mode (1: slips, 2: asks), born_ms, base_fail, base_engage, action, history (an array of ENTRY).
    """
    h = F.coalesce("history", F.array().cast(f"array<{ENTRY}>"))
    age_days = (F.lit(now_ms) - F.col("born_ms")) / DAY_MS

    solid = lambda e: e["sample"] >= SLIP_SAMPLE
    graduated = (F.size(h) >= GRADUATE) & F.forall(last_of(h, GRADUATE), lambda e: solid(e) & (e["sessions"] == 0) & (F.coalesce(e["reach"], F.lit(0)) > 0))
    last = F.try_element_at(h, F.lit(-1))
    holds = F.col("action").isNull() | F.coalesce((last["hold"] >= DEFAULT.fade) & ~F.coalesce(last["refused_rose"], F.lit(False)), F.lit(False))
    closed = (F.size(h) >= CLOSE) & F.forall(last_of(h, CLOSE), lambda e: solid(e) & (e["fail"] <= F.col("base_fail") * CLOSE_FACTOR)) & holds
    slip_wrong = (F.size(h) >= SLIP_FALSIFY) & (age_days >= SLIP_FALSIFY_DAYS) & F.forall(h, lambda e: ~solid(e) | (e["fail"] > F.col("base_fail") * SLIP_FALSIFY_FACTOR))

    enough = lambda e: e["sample"] >= ASK_SAMPLE
    engage = F.coalesce("base_engage", F.lit(0.0))
    learned = (engage > 0) & (F.size(h) >= LEARN) & F.forall(last_of(h, LEARN), lambda e: enough(e) & (e["fail"] <= F.col("base_fail") * LEARN_FACTOR) & (F.coalesce(e["engage"], F.lit(0.0)) >= engage * ENGAGE_HOLD))
    alive = F.coalesce(F.array_max(F.transform(F.filter(h, lambda e: e["sessions"] > 0), lambda e: e["built_ms"])), F.col("born_ms"))
    lapsed = F.lit(now_ms) - alive >= LAPSE_DAYS * DAY_MS
    ask_wrong = (F.size(h) >= ASK_FALSIFY) & (age_days >= ASK_FALSIFY_DAYS) & F.exists(h, enough) & F.forall(h, lambda e: ~enough(e) | (e["fail"] > F.col("base_fail") * ASK_FALSIFY_FACTOR))

    slips = F.col("mode") == 1
    via = F.when(slips & graduated, "graduated").when(slips & closed, "closed").when(~slips & learned, "learned")
    state = F.when(via.isNotNull(), "healed").when(slips & slip_wrong, "wrong").when(~slips & lapsed, "lapsed").when(~slips & ask_wrong, "wrong").otherwise("open")
    return patches.withColumns({"next_state": state, "via": via})


def with_entry(patches: DataFrame, entries: DataFrame, most: int = DEFAULT.history) -> DataFrame:
    """patches with a run's entry (id, entry) at the end of their history, in place of one of the same time."""
    own = patches.join(entries, "id", "left")
    kept = F.filter(F.coalesce("history", F.array().cast(f"array<{ENTRY}>")), lambda e: e["built_ms"] != F.col("entry.built_ms"))
    return own.withColumn("history", F.when(F.col("entry").isNotNull(), last_of(F.array_append(kept, F.col("entry")), most)).otherwise(F.col("history"))).drop("entry")


def rehome(patches: DataFrame, live: DataFrame, centres: DataFrame, pipeline: str) -> DataFrame:
    """patches with home or, if their category is gone and no centre is near and clear enough, dormant.

    Patches of asks (mode 2) are at home in no category, and never sleep.
    live: name, distinct. centres: idx, centre, label of a frozen model, a few dozen rows.
    """
    known = live.select(F.col("name").alias("home"), F.lit(True).alias("__live"))
    own = patches.join(known, "home", "left")
    lost = own.where("__live is null and centroid is not null and mode <> 2").where(F.col("pipeline") == pipeline)
    near = top_two(lost.select("id", "centroid"), centres.select("idx", "centre"), ["id"], ANCHOR, MARGIN, vector="centroid").where("anchored")
    near = near.join(centres.select("idx", F.col("label").alias("new_home")), "idx").join(live.select(F.col("name").alias("new_home")), "new_home", "left_semi").select("id", "new_home")
    own = own.join(near, "id", "left")
    return own.withColumns({"dormant": (F.col("mode") != 2) & F.col("__live").isNull() & F.col("new_home").isNull(), "home": F.coalesce("new_home", "home")}).drop("__live", "new_home")


def preferred_patch(patches: DataFrame) -> DataFrame:
    """The patch of each home that counts: an open one before others, the earliest of those."""
    best = F.min(F.struct((F.col("state") != "open").alias("closed"), "seq", "id"))
    return patches.groupBy("home").agg(best.alias("b")).select("home", F.col("b.id").alias("id"))


def trend_word(history: Column, base_fail: Column) -> Column:
    rate = F.try_element_at(history, F.lit(-1))["fail"] / F.nullif(base_fail, F.lit(0.0))
    return F.when(rate >= DEFAULT.rise, "opening").when(rate <= DEFAULT.fade, "closing")
