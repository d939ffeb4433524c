"""What keeps work in proportion to the input: seen in plans, on tables of a few rows."""

from pyspark.sql import functions as F

from colloquy import summaries
from colloquy.functions import text
from colloquy.operators import exchanges, phrases


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def labelled(spark):
    rows = [("r", "s", f"k{i}", i, f"please look at term{i % 3} and term9", [f"term{i % 3}"]) for i in range(6)]
    return spark.createDataFrame(rows, "record string, session string, key string, ms long, reply string, ai_terms array<string>")


def test_ask_windows_meet_rows_by_their_terms(spark):
    own, rituals = labelled(spark), spark.createDataFrame([("r", "please look")], "record string, phrase string")
    patches = spark.createDataFrame([("r", "a", ["term0", "term1"]), ("r", "b", ["other"])], "record string, id string, terms array<string>")
    found = phrases.ask_window_reads(own, rituals, patches, F.lit(3))
    # Of the rows 0 to 3 all but 2 name a term, and 2 has one of the next answer.
    assert sorted(map(tuple, found.collect())) == [("r", "a", 1.0, 0.0, 1, 4), ("r", "b", 0.0, 0.0, 0, 4)]
    assert "collect_list" not in plan(found)


def test_one_window_is_counted_without_the_patches(spark):
    own, rituals = labelled(spark), spark.createDataFrame([("r", "please look")], "record string, phrase string")
    patches = spark.createDataFrame([("r", "a", ["term0"]), ("other", "b", ["term0"])], "record string, id string, terms array<string>")
    found = phrases.ask_window_reads(own, rituals, patches, F.lit(2))
    # Of the rows 0 to 2, 0 names term0 and 2 has it of the next answer, which lies outside; b's record has no rows.
    assert sorted(map(tuple, found.collect())) == [("other", "b", 0.0, 0.0, 0, 0), ("r", "a", 2 / 3, 0.0, 1, 3)]
    assert "Union" not in plan(found)


def test_patches_count_copies_of_an_answer_once(spark):
    rows = [("r", f"s{i}", key, said) for i, (key, said) in enumerate([("k1", "alpha beta"), ("k1", "alpha beta"), ("k1", "alpha beta"), ("k2", "beta gamma"), ("k3", "beta beta")])]
    own = spark.createDataFrame(rows, "record string, session string, key string, said string")
    own = own.withColumn("ai_terms", F.transform(exchanges.term_counts(F.col("said"), 24), lambda x: x["term"]))
    found = summaries.term_patches(own)
    assert [tuple(r) for r in found.collect()] == [("r", "beta", ["beta"])]
    # No filter computes the terms a second time.
    assert plan(found).count("regexp_extract_all(") == 1


def test_ask_spans_count_rows_between_their_asks(spark):
    own, rituals = labelled(spark), spark.createDataFrame([("r", "please look")], "record string, phrase string")
    patches = spark.createDataFrame([("r", "a", ["term1"]), ("r", "b", ["term1"])], "record string, id string, terms array<string>")
    asks = spark.createDataFrame([("r", "a", "k1"), ("r", "a", "k4")], "record string, id string, key string")
    found = phrases.ask_span_reads(own, rituals, patches, asks)
    # Of the rows 1 to 4, 1 and 4 name it and 3 does by the next answer; b has no asks.
    assert sorted(map(tuple, found.collect())) == [("r", "a", 0.75, 0.0, 1, 4), ("r", "b", 0.0, 0.0, 0, 0)]
    assert "collect_list" not in plan(found)


def test_phrases_read_a_text_once(spark):
    df = spark.createDataFrame([("Ok, GO on: one two three four five six",), ("short - whole text",), (" 1. a b",), ("",), (None,)], "reply string")
    out = [r[0] for r in df.select(text.phrases(F.col("reply"))).collect()]
    assert out == [["ok go", "ok go on", "ok go on one"], ["short whole", "short whole text"], [text.NUMBERED, "1 a", "1 a b"], [], []]
    assert plan(df.select(text.phrases(F.col("reply")).alias("found"))).count("lower(") == 1


def test_extensions_are_found_in_one_pass(spark):
    found = spark.createDataFrame([("r", p) for p in ("go", "go on", "go on now", "gone away", text.NUMBERED)], "record string, phrase string")
    kept = phrases.without_extensions(found, ["record"])
    assert sorted(r["phrase"] for r in kept.collect()) == sorted(["go", "gone away", text.NUMBERED])
    assert "Join" not in plan(kept)
