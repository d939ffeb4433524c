"""One run from turns to a written report: moments, categories, patches, wordings, folds, report."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import evidence, phrases, state
from . import lift, profile, refresh, report
from .store import SCHEMAS, Store

#: A wording that belongs to no section is kept, so that it is not asked for again, and prints nowhere.
NOWHERE = "none"


@dataclass(frozen=True)
class Words:
    """What a model, or whatever stands for one, says: names of clusters, wordings of categories and of patches."""

    namer: refresh.Namer
    voice: profile.Voice
    patches: lift.Voice | None = None


def accepted(answers: dict[str, dict], asked: list[dict], sections: list[str]) -> dict[str, dict] | None:
    """The answers that are of use; None if any of them has a numeral: then the whole batch is refused.

    An answer for what wasn't asked, without a known section, or without a line is left out and asked for
    again. A quote that is no candidate is none.
    """
    known, out = {a["name"]: a for a in asked}, {}
    for name, a in answers.items():
        section, line = a.get("section"), re.sub(r"\s+", " ", a.get("line") or "").strip()
        if name not in known:
            continue
        if section == NOWHERE:
            out[name] = {"section": NOWHERE, "line": "", "signal": "", "quote": ""}
        elif section in sections and line:
            signal = (a.get("signal") or "").strip()
            if re.search(r"\d", line + signal):
                return None
            out[name] = {"section": section, "line": line, "signal": signal, "quote": a["quote"] if a.get("quote") in known[name]["candidates"] else ""}
    return out


def cached_voice(store: Store, record: str, live: DataFrame, voice: profile.Voice, sections: list[str]) -> profile.Voice:
    """A voice that asks only for what has no wording yet, or none that may be used again, and keeps what it hears.

    live: name, seq of the category's birth. A category that ended and was born again is worded anew, and
    wordings of ended ones go. A refused batch leaves the wordings as they are.
    """

    def say(asked: list[dict]) -> dict[str, dict]:
        spark = store.spark
        work = spark.createDataFrame([(a["name"], a["candidates"]) for a in asked], "name string, candidates array<string>")
        work = work.join(live.select("name", F.col("seq").alias("born_seq")), "name")
        cache = store.read("voices").where(F.col("record") == record)
        plan = state.cache_plan(work, cache, sections[-1]).collect()  # a row a category
        born, parts = {r["name"]: r["born_seq"] for r in plan}, ("section", "line", "signal", "quote")
        words = {r["name"]: {c: r[f"cached_{c}"] for c in parts} for r in plan if r["plan"] == "reuse"}
        wanted = [a for a in asked if a["name"] in born and a["name"] not in words]
        heard = accepted(voice(wanted), wanted, sections) if wanted else {}
        fresh = spark.createDataFrame([(n, born[n], *(w[c] for c in parts), record) for n, w in (heard or {}).items()], SCHEMAS["voices"])
        kept = state.merge_cache(cache, fresh, live.select("name", F.col("seq").alias("born_seq")), ["name", "born_seq"])
        if heard:
            store.replace("voices", kept)
        return words | (heard or {})

    return say


def folds_of(store: Store, record: str, tuned: DataFrame) -> list[report.Fold]:
    """The stored groups of rows, of which members without a row are gone. A group is of its members' section."""
    groups = evidence.tune_groups(store.read("groups").where(F.col("record") == record), tuned)
    sections = {r["name"]: r["section"] for r in tuned.select("name", "section").collect()}
    out = []
    for row in groups.collect():
        facets = {m["name"]: m["facet"] for m in row["members"]}
        if len({sections[n] for n in facets}) == 1:
            out.append(report.Fold(sections[next(iter(facets))], row["line"], facets))
    return sorted(out, key=lambda f: f.line)


def run(store: Store, turns: DataFrame, record: str, now_ms: int, sections: list[str], words: Words, path: str | None = None, rebuild: bool = False, whole: bool = False, built: str | None = None) -> str | None:
    """Ingest, build or grow, measure and mint patches, word, fold, and write the report. None if no category has a row.

    Labelled moments are written once, as all parts read them. Everything is stored before the report is.
    """
    refresh.refresh(store, turns, record, rebuild, whole, words.namer)
    mine = F.col("record") == record
    live = state.fold_log(store.read("categories").where(mine), ["record", "name"], ["seq"])
    centres = store.read("centres").where(mine & (F.col("pipeline") == refresh.PIPELINE))
    with store.held(refresh.labelled(store, record)) as labelled, store.held(live) as live:
        rituals = phrases.ask_rituals(labelled)
        patches = lift.run(store.read("patches").where(mine), labelled, live, centres, refresh.PIPELINE, now_ms, words.patches, rituals)
        store.replace("patches", patches)
        say = cached_voice(store, record, live, words.voice, sections)
        own = store.read("patches").where(mine)
        known = evidence.tune_rows(store.read("voices").where(mine), store.read("assignments").where(mine), own)
        text = profile.build(labelled, live, say, sections, lift.clauses(own), folds=folds_of(store, record, known), built=built)
        if text is not None:
            done = labelled.agg(F.count(F.lit(1)).alias("moments"), F.countDistinct("session").alias("sessions"))
            render = done.select(F.lit(now_ms).alias("at_ms"), "moments", "sessions", F.lit(live.count()).alias("categories"), F.lit(len(re.findall(r"(?m)^- .*×", text))).alias("rows"), F.lit(record).alias("record"))
            before = store.read("renders").where(mine & (F.col("at_ms") != now_ms))
            store.replace("renders", state.last_entries(before.unionByName(render), ["record"], "at_ms", DEFAULT.history))
            if path:
                profile.write(store.spark, text, path)
    return text
