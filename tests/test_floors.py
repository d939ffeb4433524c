"""Planted moments that stand just at the floors that hold everywhere, and just under them."""

import pytest

from colloquy.operators import metrics, miners, phrases
from colloquy.plans import profile

SCHEMA = "record string, session string, key string, ms long, pile string, kinds array<string>, tools array<string>, denied array<string>, reply string, reply_len int, said_len int, calls int"


def moment(session, i, kinds=(), tools=(), pile="ordinary", reply="x", said_len=10, calls=0, day=0):
    return ("r", session, f"{session}-{i:05d}", day * 86_400_000 + i * 1000, pile, list(kinds), list(tools), [], reply, len(reply), said_len, calls)


def labelled(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [29, 30])
def test_the_action_that_answers(spark, n):
    """A category of n answered moments, each followed by a tool that is rare otherwise: thirty are enough, with a lift of five."""
    rows = [m for i in range(n) for m in (moment("a", 2 * i, ["wants it seen"]), moment("a", 2 * i + 1, [], ["Show"]))]
    rows += [moment("b", i, ["other"], ["Run"]) for i in range(200)]
    rows += [moment("c", 10 + i, [], ["Show"]) for i in range(30 - n)]  # the tool itself has thirty
    got = metrics.action_mapping(labelled(spark, rows)).where("name = 'wants it seen'").collect()
    total = len(rows)
    assert [(r["action"], round(r["lift"], 6)) for r in got] == ([("Show", round(1 / (30 / total), 6))] if n == 30 else [])


def test_a_lift_under_five_is_none(spark):
    rows = [m for i in range(40) for m in (moment("a", 2 * i, ["k"]), moment("a", 2 * i + 1, [], ["Show"]))]
    rows += [moment("b", i, [], ["Run"]) for i in range(119)]  # 40 of 199 moments show: a lift under five
    assert metrics.action_mapping(labelled(spark, rows)).where("name = 'k'").isEmpty()
    assert not metrics.action_mapping(labelled(spark, [*rows, moment("b", 200, [], ["Run"])])).where("name = 'k'").isEmpty()


def test_signals_and_scoreboard_at_the_cut(spark):
    """Half of what goes wrong and a quarter of the rest: a lift of exactly two, in three sessions."""
    rows = [moment(f"s{i % 3}", i, ["sharp"] if i < 10 else [], pile="decline") for i in range(20)]
    rows += [moment(f"s{i % 3}", 100 + i, ["sharp"] if i < 20 else ["dull"]) for i in range(80)]
    rows += [moment(f"t{i % 2}", 300 + i, ["few"], pile="interrupt") for i in range(4)]  # only two sessions
    own = labelled(spark, rows)
    names = spark.createDataFrame([("r", n) for n in ("sharp", "dull", "few")], "record string, name string")
    tallied = metrics.tally(own, names)
    lifts = {r["name"]: r["lift"] for r in tallied.collect()}
    assert lifts["sharp"] == pytest.approx((10 / 24) / (20 / 80)) and lifts["sharp"] < 2
    assert metrics.signal_categories(tallied).isEmpty()
    own = labelled(spark, [*rows[:20], *rows[20:100]])
    tallied = metrics.tally(own, names)
    assert [r["name"] for r in metrics.signal_categories(tallied).collect()] == ["sharp"]  # exactly two
    board = metrics.scoreboard(own, metrics.signal_categories(tallied)).first()
    assert (board["moments"], board["carrying"], board["per_hundred"]) == (100, 30, 30.0)


@pytest.mark.parametrize("pairs", [9, 10])
def test_rituals_of_ten_pairs(spark, pairs):
    """A phrase whose next answer explains: of ten pairs in three sessions, far above what is usual."""
    rows = [m for i in range(pairs) for m in (moment(f"s{i % 3}", 2 * i, reply="walk me through it"), moment(f"s{i % 3}", 2 * i + 1, reply="fine", said_len=900))]
    rows += [moment("z", i, reply="go on then", said_len=5) for i in range(100)]
    found = {r["phrase"] for r in phrases.ask_rituals(labelled(spark, rows)).collect()}
    assert ("walk me" in found) is (pairs == 10) and "go on" not in found


def test_approvals_by_their_own_openings(spark):
    said = ["Exactly!", "ok good, go on", "OK", "great", "greatly so", "Perfect. " + "x" * 60, "this is good", "clear?", "nice one"]
    rows = [("r", "s", i, f"h{i}", p, f"before {i}", False, i * 1000) for i, p in enumerate(said)]
    own = spark.createDataFrame(rows, "record string, session string, idx long, hash string, prompt string, said string, pasted boolean, ms long")
    assert [r["idx"] for r in miners.approvals(own).orderBy("idx").collect()] == [0, 1, 3, 6, 7, 8]
    win = miners.wins(own).first()
    assert win["receipts"] == {"approvals": 6} and list(win["detail"]) == ["before 0", "before 2", "before 5"]


def test_quotes_of_25_to_210(spark):
    rows = [moment(f"s{i}", i, ["k"], reply="q" * n) for i, n in enumerate([24, 25, 210, 211])]
    assert [[len(q) for q in r["candidates"]] for r in profile.quotes(labelled(spark, rows)).collect()] == [[25, 210]]
