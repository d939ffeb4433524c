"""From a record's store to its report: statistics and choices on Spark, the text of a few dozen rows on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..operators import metrics, phrases, state
from . import report

#: From categories (name, lift, candidates: list of quotes) to their wording (section, line, quote) by name.
Voice = Callable[[list[dict]], dict[str, dict]]
# The lengths of quotes.
QUOTE_MIN, QUOTE_MAX = 25, 210


def quotes(labelled: DataFrame) -> DataFrame:
    """(record, name, candidates): short replies, of the fewest categories first, from different sessions after three."""
    own = labelled.where((F.col("reply_len") >= QUOTE_MIN) & (F.length("reply") <= QUOTE_MAX)).withColumn("of", F.size("kinds")).withColumn("name", F.explode(F.array_distinct("kinds")))
    best = state.diverse_quotes(own.select("record", "name", "session", "reply", "of", "key"), ["record", "name"], [F.col("of"), F.length("reply"), F.col("key")])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "reply"))), lambda x: x["reply"])
    return best.groupBy("record", "name").agg(listed.alias("candidates"))


def provenance(labelled: DataFrame) -> report.Provenance | None:
    """Conversations and moments within the evidence window: every number tells of the same days. One record's moments."""
    own = labelled.where("ms is not null").withColumn("day", F.to_date(F.timestamp_millis("ms")))
    window = metrics.evidence_window(own.select("record", "day").distinct(), ["record"])
    inside = metrics.within_days(own, window, ["record"]).agg(F.countDistinct("session").alias("sessions"), F.countDistinct("key").alias("moments"), F.min("day").alias("a"), F.max("day").alias("z")).first()
    return report.Provenance(inside["sessions"], inside["moments"], str(inside["a"]), str(inside["z"])) if inside["moments"] else None


def build(labelled: DataFrame, categories: DataFrame, voice: Voice, sections: list[str], clauses: DataFrame | None = None, key_lines: list[str] = [], folds: list[report.Fold] = [], built: str | None = None, limits: Thresholds = DEFAULT) -> str | None:  # noqa: B006
    """The report of one record, None if no category has a row. categories: record, name, seq, perhaps scope.

    labelled: moments with kinds. Sections are the voice's choice; rows of the last one need their quote.
    """
    own = metrics.personal(categories)
    stats = metrics.verdicts(labelled, own.select("record", "name"), limits).where("n > 0")
    work = stats.join(quotes(labelled), ["record", "name"])
    told = [row.asDict() for row in work.select("name", "n", "sessions", "lift", "direction", "verified", "candidates").orderBy(F.desc("n"), "name").collect()]  # a row a category
    words = voice([{k: row[k] for k in ("name", "lift", "candidates")} for row in told]) if told else {}
    rows = []
    for row in told:
        w = words.get(row["name"])
        if w is None or w["section"] not in sections or (w["section"] == sections[-1] and w.get("quote") not in row["candidates"]):
            continue
        # A one-sided trend may not print on what is asked for: it would tell to stop what works.
        trend = row["direction"] if row["verified"] or w["section"] == sections[-1] else None
        rows.append(report.Row(row["name"], w["section"], w["line"], row["n"], row["sessions"], trend, w["quote"] if w["section"] == sections[-1] else None))
    if not rows:
        return None
    named = {r.name for r in rows}
    owned: dict[str, list[str]] = {}
    for row in phrases.signatures(labelled, own, limits).orderBy("name", "place").collect():  # two phrases for each of ten categories
        if row["name"] in named:
            owned.setdefault(row["name"], []).append(row["phrase"])
    shown = {c["name"]: report.Clause(c["clause"], c["slip"], c["trend"]) for c in clauses.orderBy("place").collect()} if clauses is not None else {}
    return report.assemble(rows, sections, owned, provenance=provenance(labelled), folds=folds, clauses=shown, key_lines=key_lines, built=built)


def write(spark, text: str, path: str) -> None:
    """Writes a report in place of an older one, by renaming: readers see one or the other."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fresh = hadoop.Path(path), hadoop.Path(f"{path}.new")
    files = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()) if target.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files.rename(fresh, target, options)
