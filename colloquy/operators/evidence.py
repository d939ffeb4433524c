"""The gate between proposals and what is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_quote

CAP, FANOUT = 5, 2

#: Why a proposal is refused, as readers know it.
REASONS = {
    "name": "name is not kebab-case",
    "installed": "duplicates an installed skill",
    "uncited": "cites no evidence",
    "numerals": "numerals in prose — receipts are code-stamped",
    "moves": "moves must be one to five lines",
    "quote": "quote is not verbatim from cited evidence",
    "cap": "over the cap",
    "backed": "evidence {} already backs two accepted proposals",
}


def reasons(proposals: DataFrame, evidence: DataFrame, installed: DataFrame) -> DataFrame:
    """proposals (seq, name, description, standard, moves, citations, quote) with reasons, all but those of order.

    evidence: id, quotes. installed: name, minted.
    """
    cited = proposals.select("seq", "quote", F.posexplode_outer("citations").alias("place", "id")).join(evidence.select("id", "quotes", F.lit(True).alias("known")), "id", "left")
    q = normal_quote(F.col("quote"))
    verbatim = F.coalesce((q != "") & F.exists("quotes", lambda w: F.contains(normal_quote(w), q)), F.lit(False))
    cited = cited.groupBy("seq").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull() & F.col("known").isNull(), F.struct("place", "id")))), lambda x: F.concat(F.lit("unknown evidence: "), x["id"])).alias("unknown"),
        F.bool_or(verbatim).alias("verbatim"),
    )
    taken = installed.where("not minted").select(F.lower("name").alias("__name")).distinct().withColumn("__taken", F.lit(True))
    own = proposals.join(cited, "seq", "left").join(taken, F.lower(proposals["name"]) == F.col("__name"), "left")
    prose = F.concat_ws(" ", "description", "standard", F.array_join(F.coalesce("moves", F.array().cast("array<string>")), " "), "quote")
    n_moves, n_cited = F.coalesce(F.size("moves"), F.lit(0)), F.coalesce(F.size("citations"), F.lit(0))
    checks = F.array_compact(
        F.array(
            F.when(~F.col("name").rlike("^[a-z][a-z0-9-]{1,63}$"), REASONS["name"]),
            F.when(F.col("__taken"), REASONS["installed"]),
            F.when(n_cited <= 0, REASONS["uncited"]),
        )
    )
    later = F.array_compact(
        F.array(
            F.when(prose.rlike("[0-9]"), REASONS["numerals"]),
            F.when((n_moves <= 0) | (n_moves > 5), REASONS["moves"]),
            F.when((F.coalesce("quote", F.lit("")) != "") & ~F.coalesce("verbatim", F.lit(False)), REASONS["quote"]),
        )
    )
    return own.withColumn("reasons", F.concat(checks, F.coalesce("unknown", F.array().cast("array<string>")), later)).drop("unknown", "verbatim", "__name", "__taken")


def dispose(proposals: DataFrame, evidence: DataFrame, installed: DataFrame) -> list[dict]:
    """Every proposal with ok and reasons.

    Only accepted ones use up the cap and the fan-out of evidence, so the last step goes through the
    proposals in order. They are a model's single answer, a few dozen rows.
    """
    accepted, backs, out = 0, {}, []
    for row in reasons(proposals, evidence, installed).orderBy("seq").collect():
        why, cites = list(row["reasons"]), row["citations"] or []
        if accepted >= CAP:
            why.append(REASONS["cap"])
        if not why:
            over = [c for c in cites if backs.get(c, 0) >= FANOUT]
            why += [REASONS["backed"].format(c) for c in over]
            if not over:
                accepted += 1
                backs |= {c: backs.get(c, 0) + 1 for c in cites}
        out.append({"seq": row["seq"], "name": row["name"], "ok": not why, "reasons": why})
    return out


def plan_install(artifacts: DataFrame, verdicts: DataFrame, existing: DataFrame) -> DataFrame:
    """artifacts (name, content) as covered, new, updated or unchanged. verdicts: name, cover. existing: name, content."""
    own = artifacts.join(verdicts.select("name", "cover"), "name", "left").join(existing.select("name", F.col("content").alias("old")), "name", "left")
    return own.withColumn("action", F.when(F.col("cover").isNotNull(), "covered").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("content"), "unchanged").otherwise("updated"))


def one_name_each(names: DataFrame, piles: DataFrame) -> DataFrame:
    """Of a model's names (pile, seq, name) the first for each pile that exists."""
    own = names.join(piles.select("pile").distinct(), "pile", "left_semi")
    return own.withColumn("__n", F.row_number().over(Window.partitionBy("pile").orderBy("seq"))).where("__n = 1").drop("__n")


def tune_rows(voices: DataFrame, assignments: DataFrame, patches: DataFrame) -> DataFrame:
    """What can be acted on: the worded categories of a record with their counts and the patch of each that counts."""
    from .patches import preferred_patch

    counts = assignments.select("record", F.explode("kinds").alias("name")).groupBy("record", "name").agg(F.count(F.lit(1)).alias("n"))
    best = preferred_patch(patches).select(F.col("id"))
    own = patches.join(best, "id", "left_semi").select(
        F.col("home").alias("name"), F.struct("id", F.col("wording.text").alias("when"), F.coalesce("wording.do_this", F.lit("")).alias("do_this"), F.coalesce("wording.y", F.lit("")).alias("own_voice"), "action", F.coalesce("reach", F.lit(0)).alias("reach"), F.coalesce("slip", F.lit(0)).alias("slip"), "state").alias("patch")
    )
    return voices.join(counts, ["record", "name"], "left").join(own, "name", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("record", "name", "born_seq", "section", "line", "signal", "quote", "n", "patch")


def tune_groups(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Groups (record, line, members, facets) with the rows of their members, in order: (record, line, members: array of facet, name, n).

    A member without a row goes, and its facet with it.
    """
    each = groups.select("record", "line", F.posexplode(F.arrays_zip("members", "facets")).alias("place", "m")).select("record", "line", "place", F.col("m.members").alias("name"), F.coalesce("m.facets", F.lit("")).alias("facet"))
    kept = each.join(rows.select("record", "name", "n"), ["record", "name"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "facet", "name", "n"))), lambda x: F.struct(x["facet"].alias("facet"), x["name"].alias("name"), x["n"].alias("n")))
    return kept.groupBy("record", "line").agg(listed.alias("members"))
