"""The whole run on a planted archive of known counts, and what it keeps for the next."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.operators import evidence
from colloquy.plans import cycle
from colloquy.plans.store import Store
from colloquy.sources import base, dialect_a, recent

# Six asks, told in turn, so that crowds of replies come out alike in every run.
ASKS = [
    "can we plan this out first before touching code",
    "is there a smaller slice we could ship instead",
    "show me the actual number, not a summary",
    "wait, why is that running again",
    "lets do the simplest thing that works here",
    "where are the docs for this bit",
]
SECTIONS = ["frame", "judge", "register"]


def transcript(name, exchanges, day):
    """Asks and answers with tools; every fifth answer is interrupted, every seventh tool denied."""
    lines, begin = [], datetime(2026, 6, 1, 9, tzinfo=UTC) + timedelta(days=day)

    def add(**row):
        ts = (begin + timedelta(seconds=90 * len(lines))).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        lines.append(json.dumps({"sessionId": f"s-{name}", "cwd": "/w/proj", "gitBranch": "main", "entrypoint": "cli", "uuid": f"{name}-{len(lines)}", "timestamp": ts} | row))

    text = lambda t: {"content": [{"type": "text", "text": t}]}
    for i in range(exchanges):
        add(type="user", message=text(f"{ASKS[i % 6]} ({name}-{i})"))
        use = {"type": "tool_use", "id": f"c-{name}-{i}", "name": "Read" if i % 3 == 0 else "Bash", "input": {}}
        add(type="assistant", message={"content": [{"type": "text", "text": f"here is what I found for {name}-{i}, in detail, with the tradeoffs laid out"}, use]})
        if i % 5 == 4:
            add(type="user", message=text("[Request interrupted by user]"))
        if i % 7 == 6:
            add(type="user", toolDenialKind="user-rejected", message={"content": [{"type": "tool_result", "tool_use_id": use["id"]}]})
        add(type="user", message=text(f"{ASKS[(i + 2) % 6]} — following up on {name}-{i}"))
    return "\n".join(lines) + "\n"


class Model:
    """Stands for a model: words by a fixed rule, and what it was asked."""

    def __init__(self):
        self.asked = []

    def voice(self, work):
        self.asked.append(sorted(w["name"] for w in work))
        return {w["name"]: {"section": SECTIONS["ab".index(w["name"][-1])], "line": f"offer the thing for {w['name']}", "signal": "wants the thing", "quote": w["candidates"][0]} for w in work}

    def words(self):
        return cycle.Words(lambda i: f"pattern-{chr(97 + i)}", self.voice)


@pytest.fixture
def turns(spark, tmp_path):
    folder = tmp_path / "projects" / "proj"
    folder.mkdir(parents=True)
    for f in range(8):
        (folder / f"session-{f:03d}.jsonl").write_text(transcript(f"f{f}", 10, f))
    return base.by_file(dialect_a.turns(base.read_lines(spark, str(tmp_path / "projects")), "r"))


def test_the_planted_archive(spark, tmp_path, turns):
    store, model = Store(spark, f"file://{tmp_path}/store"), Model()
    text = cycle.run(store, turns, "r", 1_781_000_000_000, SECTIONS, model.words(), f"file://{tmp_path}/report.md", built="now")
    assert store.read("moments").count() == 160
    kinds = store.read("assignments").select(F.explode("kinds").alias("k")).groupBy("k").count()
    assert {r["k"]: r["count"] for r in kinds.collect()} == {"pattern-a": 32, "pattern-b": 128}
    assert (tmp_path / "report.md").read_text() == text
    assert "From 8 conversations, 2026-06-01 to 2026-06-08; 160 moments." in text
    assert "- show me → pattern-a" in text
    assert text.index("## frame") < text.index("offer the thing for pattern-a (32×") < text.index("## judge") < text.index("offer the thing for pattern-b (128×")
    assert model.asked == [["pattern-a", "pattern-b"]]

    # A second run adds nothing and asks for nothing; the ring has both.
    assert cycle.run(store, turns, "r", 1_781_000_100_000, SECTIONS, model.words(), built="now") == text
    assert model.asked == [["pattern-a", "pattern-b"]] and store.read("moments").count() == 160
    assert [r["at_ms"] for r in store.read("renders").orderBy("at_ms").collect()] == [1_781_000_000_000, 1_781_000_100_000]

    # A wording with a numeral is asked for again; a batch with one is refused, and the row doesn't print.
    voices = store.read("voices").withColumn("line", F.when(F.col("name") == "pattern-a", "offer 3 things").otherwise(F.col("line")))
    store.replace("voices", voices)
    loud = Model()
    loud.voice = lambda work: loud.asked.append([w["name"] for w in work]) or {w["name"]: {"section": "frame", "line": "offer 2 things", "quote": ""} for w in work}
    text = cycle.run(store, turns, "r", 1_781_000_200_000, SECTIONS, loud.words())
    assert loud.asked == [["pattern-a"]] and "pattern-a (" not in text and "pattern-b (128×" in text

    rows = evidence.tune_rows(store.read("voices"), store.read("assignments"), store.read("patches"))
    assert {r["name"]: r["n"] for r in rows.collect()} == {"pattern-a": 32, "pattern-b": 128}
    groups = spark.createDataFrame([("both", ["pattern-b", "gone", "pattern-a"], ["one", "two"], "r")], "line string, members array<string>, facets array<string>, record string")
    assert [[tuple(m) for m in r["members"]] for r in evidence.tune_groups(groups, rows).collect()] == [[("one", "pattern-b", 128), ("", "pattern-a", 32)]]


def test_what_is_accepted():
    asked = [{"name": "a", "candidates": ["q"]}, {"name": "b", "candidates": []}]
    fine = {"a": {"section": "frame", "line": " offer\n it ", "quote": "q"}, "b": {"section": "none"}, "c": {"section": "frame", "line": "x"}}
    assert cycle.accepted(fine, asked, SECTIONS) == {"a": {"section": "frame", "line": "offer it", "signal": "", "quote": "q"}, "b": {"section": "none", "line": "", "signal": "", "quote": ""}}
    assert cycle.accepted({"a": {"section": "frame", "line": "x", "quote": "z"}, "b": {"section": "odd", "line": "x"}}, asked, SECTIONS)["a"]["quote"] == ""
    assert cycle.accepted({**fine, "b": {"section": "judge", "line": "say it 2 times"}}, asked, SECTIONS) is None


def test_the_latest_exchanges_of_the_archive(spark, tmp_path, turns):
    source = base.SourceDialect("r", (f"file://{tmp_path}/projects",), lambda lines, record: dialect_a.turns(lines, record))
    got = recent.read_recent(spark, source, 25, first=1)
    assert got.count() == 25 and sorted(r["session"] for r in got.select("session").distinct().collect()) == ["session-006", "session-007"]


@pytest.mark.parametrize("changed", [False, True])
def test_drift_is_seen_on_the_way(spark, tmp_path, turns, changed):
    """A format whose messages moved to another field is noticed by the ingest itself."""
    from pyspark.sql import Observation

    from colloquy.plans import refresh
    from colloquy.sources import files

    if changed:
        for path in (tmp_path / "projects" / "proj").glob("*.jsonl"):
            path.write_text(path.read_text().replace('"message"', '"content_v2"'))
    source = base.SourceDialect("r", (f"file://{tmp_path}/projects",), dialect_a.turns)
    seen, store = Observation("typed"), Store(spark, f"file://{tmp_path}/store")
    refresh.ingest(store, turns, seen=seen)
    assert files.drifted(spark, source, seen, 10_000) is changed and not files.drifted(spark, source, seen)
    assert seen.get["typed"] == (0 if changed else 160)
