"""The store: snapshots under numbered manifests, logs of categories over several builds."""

import json

import pytest
from pyspark.sql import functions as F
from test_operators import TURNS, turn

from colloquy.operators import state
from colloquy.plans import refresh
from colloquy.plans.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def builds(spark, n, record="r", session=1):
    return spark.createDataFrame([(session, i, "p", i, record) for i in range(n)], "sessions long, at_ms long, pipeline string, seq long, record string")


def rows(df):
    return sorted((r["record"], r["sessions"], r["seq"]) for r in df.collect())


def test_a_reader_keeps_its_rows(spark, store):
    store.append("builds", builds(spark, 3))
    store.append("builds", builds(spark, 1, "s"))
    before = store.read("builds")
    store.replace("builds", builds(spark, 2, session=9))
    assert rows(before) == [("r", 1, 0), ("r", 1, 1), ("r", 1, 2), ("s", 1, 0)]
    assert rows(store.read("builds")) == [("r", 9, 0), ("r", 9, 1), ("s", 1, 0)]
    assert rows(store.read("builds", 1)) == [("r", 1, 0), ("r", 1, 1), ("r", 1, 2)]


def test_a_write_that_dies_changes_nothing(spark, store):
    store.append("builds", builds(spark, 2))
    broken = builds(spark, 50).repartition(5).withColumn("seq", F.when(F.col("seq") == 40, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="lost"):
        store.replace("builds", broken)
    assert rows(store.read("builds")) == [("r", 1, 0), ("r", 1, 1)]
    store.vacuum("builds")
    assert rows(store.read("builds")) == [("r", 1, 0), ("r", 1, 1)]


def test_two_writers_both_count(spark, store):
    store.append("builds", builds(spark, 1))
    real, once = store.manifest, []

    def late(name, version=None):
        found = real(name, version)
        if not once:  # another writer takes the number between reading and writing it
            once.append(1)
            Store(spark, store.root).append(name, builds(spark, 1, "s"))
        return found

    store.manifest = late
    store.append("builds", builds(spark, 1, "t"))
    assert rows(store.read("builds")) == [("r", 1, 0), ("s", 1, 0), ("t", 1, 0)] and store.versions("builds") == [1, 2, 3]


def test_compact_and_vacuum(spark, store, tmp_path):
    for record in ("r", "s", "odd name=/%"):
        store.append("builds", builds(spark, 2, record))
    store.replace("builds", builds(spark, 1, "s", session=5))
    want = rows(store.read("builds"))
    store.compact("builds")
    store.append("builds", builds(spark, 1, "u"))
    store.vacuum("builds")
    assert rows(store.read("builds")) == sorted([*want, ("u", 1, 0)])
    assert len(store.manifest("builds")[1]) == 2 and len(list((tmp_path / "store/builds").glob("data=*"))) == 2
    assert all(json.loads(p.read_text()) for p in (tmp_path / "store/builds/_log").glob("*.json"))
    store.clear_derived("r")
    assert rows(store.read("builds")) == sorted([*want, ("u", 1, 0)])  # a ledger


SAID = ["please fix the failing parser before anything else", "plan the migration first and tell me where it breaks", "show me the number itself, no summary of it"]


def talk(spark, sessions):
    out = [turn(i, "user" if i % 2 else "assistant", f"{SAID[(s + i // 2) % 3]} {s} {i}" if i % 2 else "done", session=f"s{s:02d}", ts=f"2026-01-{s % 28 + 1:02d}T00:00:{i:02d}Z") for s in range(sessions) for i in range(8)]
    return spark.createDataFrame(out, TURNS)


def live(store):
    return sorted(r["name"] for r in state.fold_log(store.read("categories"), ["record", "name"], []).collect())


def test_a_build_ends_the_categories_before_it(spark, store):
    refresh.ingest(store, talk(spark, 24))
    first = refresh.cold_build(store, "r", "first {}".format)
    assert first > 1 and live(store) == [f"first {i}" for i in range(first)]
    second = refresh.cold_build(store, "r", "second {}".format)
    assert live(store) == [f"second {i}" for i in range(second)]
    third = refresh.cold_build(store, "r", lambda i: "second 0" if i == 0 else f"third {i}")
    assert live(store) == sorted(["second 0", *(f"third {i}" for i in range(1, third))])
    numbers = [r["seq"] for r in store.read("categories").collect()]
    assert len(set(numbers)) == len(numbers)  # births and ends in one order
    assert store.read("centres").count() == third and store.read("assignments").count() == store.read("moments").count()


def test_a_compacted_log_folds_as_the_whole_one(spark, store):
    refresh.ingest(store, talk(spark, 24))
    for names in ("a {}", "b {}"):
        refresh.cold_build(store, "r", names.format)
    whole, number = store.read("categories"), state.next_number(store.read("categories"))
    refresh.compact_categories(store)
    small = store.read("categories")
    assert live(store) == sorted(r["name"] for r in state.fold_log(whole, ["record", "name"], []).collect())
    assert small.where("event = 'retired'").isEmpty() and small.count() < whole.count() and state.next_number(small) == number
    refresh.cold_build(store, "r", "c {}".format)
    assert all(n.startswith("c ") for n in live(store))
    delta = store.read("categories").where(F.col("seq") >= number)
    fold = lambda log: sorted(r["name"] for r in state.fold_log(log, ["record", "name"], []).collect())
    assert fold(whole.unionByName(delta)) == fold(store.read("categories"))
