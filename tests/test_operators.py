"""Exchanges, statistics, state and reports on small cases with known answers."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import numbers, text
from colloquy.operators import evidence, exchanges, metrics, miners, mirror, patches, phrases, state, vectors
from colloquy.config import DEFAULT
from colloquy.plans import lift, profile, refresh, report
from colloquy.plans.store import Store
from colloquy.streaming import ingest

TURNS = ingest.TURNS


def turn(pos, role, text_="", session="s", ts="", **more):
    row = {"record": "r", "session": session, "pos": pos, "ts": ts, "role": role, "text": text_, "interrupted": False, "interrupt_kind": None, "denial": None, "denied_tools": None, "tools": None, "cwd": None, "git_branch": None, "images": 0}
    return row | more


def test_pairing(spark):
    rows = [
        turn(0, "assistant", "before", tools=["Read"]),
        turn(1, "user", "one", ts="2026-01-01T00:00:00Z", cwd="/w"),
        turn(2, "assistant", "a", tools=["Read", "Bash"]), turn(3, "user", interrupted=True, interrupt_kind="plain"), turn(4, "user", denial="user-rejected", denied_tools=["Bash"]), turn(5, "assistant", "b", ts="2026-01-01T00:01:00Z"),
        turn(6, "user", "two"), turn(7, "user", "three", ts="2026-01-01T00:00:30Z"), turn(8, "assistant", "tail"),
    ]
    got = exchanges.pair_exchanges(spark.createDataFrame(rows, TURNS)).orderBy("idx").collect()
    assert [(r["prompt"], r["said"], r["reaction"]) for r in got] == [("", "before", "one"), ("one", "a\nb", "two"), ("two", "", "three")]
    assert got[1]["tools"] == ["Read", "Bash"] and got[1]["denied"] == ["Bash"] and got[1]["declined"] and got[1]["interrupted"] == "plain"
    assert got[1]["ts"] == "2026-01-01T00:01:00Z" and got[1]["gap_sec"] == 60 and got[2]["gap_sec"] is None and got[2]["last_of_session"] and got[2]["cwd"] == "/w"
    assert [r["pile"] for r in exchanges.to_moments(exchanges.pair_exchanges(spark.createDataFrame(rows, TURNS))).collect()].count("decline") == 1


def test_rows_in_any_order_give_the_same(spark):
    rows = [turn(i, ("user", "assistant")[i % 2], f"t{i}", session=f"s{i % 3}") for i in range(60)]
    one = exchanges.pair_exchanges(spark.createDataFrame(rows, TURNS)).select("session", "idx", "hash").collect()
    two = exchanges.pair_exchanges(spark.createDataFrame(rows[::-1], TURNS).repartition(7)).select("session", "idx", "hash").collect()
    assert sorted(one) == sorted(two)


def test_text_functions(spark):
    df = spark.createDataFrame([("1. Do it, please now",)], "t string")
    got = df.select(text.phrases(F.col("t")), text.command_verb(F.lit("git commit -m x")), text.command_verb(F.lit("ls")), text.when_clause(F.lit("When A, B, c")), text.tool_name(F.lit("exec"), F.lit("*** Begin Patch"))).first()
    assert got[0] == [text.NUMBERED, "1 do", "1 do it", "1 do it please", "1 do it please now"] and got[1:3] == ("git commit", None)
    assert tuple(got[3]) == ("A", "B, c") and got[4] == "apply_patch"
    assert df.select(text.is_machine_artifact(F.lit("box web"), "Box.local", "ann")).first()[0]
    assert df.select(text.version_key(F.lit("1.10.2")) > text.version_key(F.lit("1.9.9"))).first()[0]
    assert df.select(numbers.round_half_up(F.lit(-0.25), 1), numbers.floor_quantile(F.array(*map(F.lit, range(5))), 0.5)).first()[:] == (-0.2, 2)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "record string, session string, key string, ms long, pile string, kinds array<string>, tools array<string>, denied array<string>, reply string, said_len int, calls int")


def test_statistics(spark):
    day = numbers.DAY_MS
    rows = [("r", f"s{i % 10}", f"k{i:04d}", i * day // 4, "interrupt" if i % 3 == 0 else "ordinary", ["x"] if i % 3 == 0 or i % 10 == 0 else ["y"], ["Bash"] if i % 2 else [], ["Bash"] if i % 7 == 0 else [], "", 0, 0) for i in range(240)]
    own = labelled(spark, rows)
    tallied = {r["name"]: r for r in metrics.tally(own, spark.createDataFrame([("r", "x"), ("r", "y"), ("r", "z")], "record string, name string")).collect()}
    assert tallied["z"]["n"] == 0 and tallied["z"]["lift"] == 0 and tallied["x"]["lift"] == pytest.approx(1 / (16 / 160))
    gaps = metrics.gap_candidates(own, metrics.signal_categories(metrics.tally(own, spark.createDataFrame([("r", "x")], "record string, name string"))).select("record", "name")).collect()
    assert gaps == []  # ordinary rows are below the floor
    assert metrics.trend(own).where("name = 'x'").first()["direction"] is None
    assert metrics.trailing(own, F.lit(59 * day)).count() == 21 * 4 + 1


def test_rituals_and_asks(spark):
    rows = []
    for i in range(40):
        ask = i % 4 == 0
        rows.append(("r", f"s{i // 8}", f"k{i:03d}", i, "ordinary", [], [], [], "how come that" if ask else f"do thing {i} now then go on", 900 if i % 4 == 1 else 10, 0))
    rituals = phrases.ask_rituals(labelled(spark, rows))
    assert {r["phrase"] for r in rituals.collect()} == {"how come", "how come that"}
    events = phrases.ask_events(labelled(spark, rows), rituals).collect()
    assert len(events) == 10 and not any(e["bounced"] for e in events)
    found = spark.createDataFrame([("r", "double check"), ("r", "double check on the"), ("r", "doubles")], "record string, phrase string")
    assert {r["phrase"] for r in phrases.without_extensions(found, ["record"]).collect()} == {"double check", "doubles"}


def test_miners(spark):
    chains = spark.createDataFrame([("r", f"s{s}", i, a) for s in range(4) for i, a in enumerate(["a", "b", "b", "c", "d"])], "record string, session string, pos int, action string")
    found = {r["chain"]: r["n"] for r in phrases.chain_grams(chains).collect()}
    assert found == {"a → b → c": 4, "b → c → d": 4, "a → b → c → d": 4}
    rows = [("r", f"s{i % 4}", i, f"h{i}", "run the tests", "said", False, i, "plain" if i in (3, 5) else None, False, "no, stop") for i in range(8)]
    own = spark.createDataFrame(rows, "record string, session string, idx int, hash string, prompt string, said string, pasted boolean, ms long, interrupted string, declined boolean, reaction string")
    kinds = [r["kind"] for r in miners.measure(own, chains).collect()]
    assert kinds.count("ritual") == 3 and kinds.count("rule") == 1


def test_mirror(spark):
    rows = [turn(i, "user", "same text?" if i < 2 else "x" * (i + 1), ts=f"2026-01-0{1 + i % 3}T10:00:00Z") for i in range(6)] + [turn(9, "user", interrupted=True, interrupt_kind="plain")]
    got = mirror.mirror(spark.createDataFrame(rows, TURNS)).first()
    assert got["messages"] == 6 and got["corrections"] == 1 and got["active_days"] == 3 and got["streak"] == 3 and got["hours_80"] == 1
    assert mirror.repeated_texts(spark.createDataFrame(rows, TURNS), "text").first()["n"] == 2
    roots = mirror.repo_roots(spark.createDataFrame([("r", "/a"), ("r", "/a/b/c"), ("r", "/ab")], "record string, folder string")).collect()
    assert {r["folder"]: r["root"] for r in roots} == {"/a": "/a", "/a/b/c": "/a", "/ab": "/ab"}


def test_seeded_numbers_and_kmeans():
    draw = vectors.random_numbers()
    assert [round(next(draw), 10) for _ in range(3)] == [0.6551540488, 0.3048143388, 0.6324834827]
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(8)[i] + 0.05 * rng.standard_normal((5, 8)) for i in range(3)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    assign, centres = vectors.kmeans(x, 3)
    assert [len(set(assign[i : i + 5])) for i in (0, 5, 10)] == [1, 1, 1] and len(set(assign)) == 3
    assert np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-5)
    assert vectors.hash_vector("") .sum() == 0 and abs(np.linalg.norm(vectors.hash_vector("abc abc de")) - 1) < 1e-6


def test_kmeans_over_all_rows_is_the_plain_one(spark):
    """The passes over tasks against plain k-means on all rows in order, seeds and all."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(6) * 2 + 0.4 * rng.standard_normal((40, 6)) for _ in range(5)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([("r" if i % 4 else "s", i, v.tolist()) for i, v in enumerate(x)], "record string, vec_id long, embedding array<float>").repartition(3)
    got = {(r["record"], r["k"]): r for r in vectors.cluster(df, [1, 3, 5, 60]).collect()}
    assert set(got) == {("r", 1), ("r", 3), ("r", 5), ("r", 60), ("s", 1), ("s", 3), ("s", 5)}
    for record in "rs":
        mine = [i for i in range(200) if (i % 4 > 0) == (record == "r")]
        assert np.allclose(got[record, 5]["before"], vectors.kmeans(x[mine], 5)[1], atol=1e-5)
        for k in (1, 3, 5):
            assign, centres = vectors.kmeans(x[mine], k)
            assert np.allclose(got[record, k]["centres"], centres, atol=1e-5)
            assert abs(got[record, k]["silhouette"] - (vectors.silhouette(x[mine], assign, centres) if k > 1 else 0)) < 1e-6
    assert vectors.derive_k(vectors.cluster(df, [3, 5])).count() == 2 and vectors.cluster(df.limit(0), [2]).count() == 0


def test_seeds_are_the_plain_draws_in_order(spark):
    """1,000 vectors, many of them equal, in an order that isn't that of their keys."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1000, 5))
    x[100:300] = x[100]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ts = rng.permutation(1000) // 3
    df = spark.createDataFrame([("r", i, int(ts[i]), v.tolist()) for i, v in enumerate(x)], "record string, vec_id long, ts long, embedding array<float>").repartition(6)
    order = sorted(range(1000), key=lambda i: (ts[i], i))
    own = vectors._ordered(df, ["ts", "vec_id"]).persist()
    assert own.select("part").distinct().count() > 1
    assert np.array_equal(vectors._seeds(own, {"r": 1000}, 12)["r"], vectors.seeded(x[order], 12))
    own.unpersist()


def test_answer_time_is_carried_on(spark):
    rows = [turn(0, "assistant", "a", ts="2026-01-01T10:00:00Z"), turn(1, "user", "one", ts=""), turn(2, "assistant", "the Spark spark planner", ts=""), turn(3, "user", "two", ts="")]
    found = exchanges.pair_exchanges(spark.createDataFrame(rows, TURNS)).orderBy("idx")
    assert [r["ts"] for r in found.collect()] == ["2026-01-01T10:00:00Z"] * 2
    assert exchanges.to_moments(found).collect()[1]["ai_terms"] == ["spark", "planner"]


def test_terms_of_equal_ids_stay_apart(spark):
    df = spark.createDataFrame([(1, "Alpha beta alpha."), (1, "alpha"), (2, None), (3, "")], "id long, t string")
    got = sorted(tuple(r) for r in exchanges.top_terms(df, ["id"], "t").collect())
    assert got == [(1, "alpha", 1, 0, 1), (1, "alpha", 2, 0, 1), (1, "beta", 1, 1, 2)]


def test_mirror_counts_words_and_roots(spark):
    texts = ["one", "a b c", "a b c d e f g h i", "x y"]
    where = [("/w", "main"), ("/w/sub", "main"), ("/w", "HEAD"), (None, None)]
    rows = [turn(i, "user", t, ts=f"2026-01-0{1 + i}T12:00:00Z", cwd=c, git_branch=b) for i, (t, (c, b)) in enumerate(zip(texts, where))]
    got = mirror.mirror(spark.createDataFrame(rows, TURNS)).first()
    assert (got["len_p25"], got["len_median"], got["len_p90"]) == (2, 3, 9)
    assert (got["repos"], got["branch_names"], got["branch_pairs"], got["span_days"]) == (1, 1, 1, 4)


ENTRY = "struct<built_ms:long,fail:double,sessions:int,sample:int,reach:int,hold:double,refused_rose:boolean,engage:double>"


def test_patch_states(spark):
    day = numbers.DAY_MS
    e = lambda t, fail, sessions, sample, reach=1, hold=1.0, engage=0.0: (t * day, fail, sessions, sample, reach, hold, False, engage)
    rows = [
        ("grad", 1, 0, 0.2, 0.0, None, [e(1, 0.0, 0, 100), e(2, 0.0, 0, 100)]),
        ("close", 1, 0, 0.2, 0.0, None, [e(1, 0.1, 1, 100), e(2, 0.1, 1, 100)]),
        ("nohold", 1, 0, 0.2, 0.0, "Bash", [e(1, 0.1, 1, 100, hold=0.1), e(2, 0.1, 1, 100, hold=0.1)]),
        ("wrong", 1, 0, 0.2, 0.0, None, [e(i, 0.2, 1, 100) for i in range(6)]),
        ("learn", 2, 90 * day, 0.2, 0.5, None, [e(95, 0.1, 1, 30, engage=0.5), e(96, 0.1, 1, 30, engage=0.4)]),
        ("lapse", 2, 0, 0.2, 0.0, None, [e(1, 0.2, 0, 30)]),
        ("new", 2, 99 * day, 0.2, 0.0, None, None),
    ]
    df = spark.createDataFrame(rows, f"id string, mode int, born_ms long, base_fail double, base_engage double, action string, history array<{ENTRY}>")
    got = {r["id"]: (r["next_state"], r["via"]) for r in patches.next_state(df, 100 * day).collect()}
    assert got == {"grad": ("healed", "graduated"), "close": ("healed", "closed"), "nohold": ("open", None), "wrong": ("wrong", None), "learn": ("healed", "learned"), "lapse": ("lapsed", None), "new": ("open", None)}
    entries = spark.createDataFrame([("wrong", e(5, 0.9, 1, 1))], f"id string, entry {ENTRY}")
    assert [x["fail"] for x in patches.with_entry(df, entries, most=3).where("id = 'wrong'").first()["history"]] == [0.2, 0.2, 0.9]


def test_gate(spark):
    schema = "seq int, name string, description string, standard string, moves array<string>, citations array<string>, quote string"
    good = lambda i, **m: tuple(({"seq": i, "name": f"skill-{'abcdefgh'[i]}", "description": "d", "standard": "s", "moves": ["m"], "citations": [f"e{i // 2}"], "quote": None} | m).values())
    rows = [good(0), good(1, citations=["e0"]), good(2, citations=["e0"]), good(3, name="Bad Name", quote="not there"), good(4, citations=["zz"]), good(5, quote="Hello, there!"), good(6, description="has 3", moves=[])]
    ev = spark.createDataFrame([(f"e{i}", ["well hello there you"]) for i in range(4)], "id string, quotes array<string>")
    installed = spark.createDataFrame([("skill-b", False)], "name string, minted boolean")
    got = evidence.dispose(spark.createDataFrame(rows, schema), ev, installed)
    assert [g["ok"] for g in got] == [True, False, True, False, False, True, False]
    assert got[1]["reasons"] == ["duplicates an installed skill"] and got[4]["reasons"] == ["unknown evidence: zz"]
    assert got[3]["reasons"] == ["name is not kebab-case", "quote is not verbatim from cited evidence"]


def test_state(spark):
    log = spark.createDataFrame([("a", "born", 1, "x"), ("a", "retired", 2, ""), ("b", "born", 3, "y"), ("b", "born", 4, "z"), ("c", "odd", 5, "")], "name string, event string, seq int, description string")
    assert [tuple(r) for r in state.fold_log(log, ["name"], ["description"]).collect()] == [("b", "z")]
    cache = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    merged = state.merge_cache(cache, spark.createDataFrame([("b", 3)], "name string, v int"), cache, ["name"])
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 1), ("b", 3)]


def test_refresh_and_stream(spark, tmp_path):
    rows = [turn(i, "user" if i % 2 else "assistant", f"please fix bug {'a' * (s % 3 + 1)} soon {s} {i}" if i % 2 else "ok", session=f"s{s}", ts=f"2026-01-{s % 28 + 1:02d}T00:00:{i:02d}Z") for s in range(12) for i in range(8)]
    store = Store(spark, f"file://{tmp_path}/store")
    turns = spark.createDataFrame(rows, TURNS)
    refresh.refresh(store, turns.where("session < 's5'"), "r")
    n = store.read("moments").count()
    assert n > 0 and store.read("assignments").count() == n
    refresh.refresh(store, turns.where("session < 's5'"), "r")
    assert store.read("moments").count() == n and store.read("assignments").count() == n
    (tmp_path / "in").mkdir()
    turns.coalesce(1).write.mode("append").json(f"{tmp_path}/in/x")
    stream = ingest.stream_turns(spark, f"{tmp_path}/in/*")
    for _ in range(2):
        ingest.follow(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    total = store.read("moments").count()
    assert total > n and store.read("assignments").count() == total
    assert refresh.labelled(store, "r").count() == total


def test_report():
    rows = [report.Row("a", "Work", "first", 5, 3), report.Row("b", "Work", "second", 9, 3), report.Row("c", "Talk", "third", 1, 1, "rising", "so it goes")]
    out = report.assemble(rows, ["Work", "Talk"])
    assert out.index("second") < out.index("first") < out.index("third") and report.looks_like_report(out)
    assert "third" not in report.assemble(rows, ["Work", "Talk"], budget=100)
    with pytest.raises(ValueError):
        report.assemble([report.Row("d", "Work", "has 3")], ["Work"])
    unit = lambda d: [np.cos(np.radians(d)), np.sin(np.radians(d)), 0.0]
    three = [report.Row(n, "Work", n) for n in "abc"]
    assert report.plan_folds(three, [unit(0), unit(10), unit(90)]) == [[0, 1]] and report.plan_folds(three[:2], [unit(0), unit(1)]) == []


def moment_rows(spark):
    """Slips of x in ten sessions over two weeks, each followed by Bash; y is calm."""
    day = numbers.DAY_MS
    rows = []
    for i in range(400):
        slip, kind = i % 4 == 0, "x" if i % 4 in (0, 1) and i % 8 < 5 else "y"
        rows.append(("r", f"s{i % 10}", f"k{i:04d}", i * day // 40, "interrupt" if slip else "ordinary", [kind], ["Bash"], [], f"please do not do that again {'now' if slip else 'later'}", 900, 0))
    return labelled(spark, rows).withColumns({"reply_len": F.length("reply"), "ai_terms": F.array(F.lit("closure"))})


def test_patches_are_minted_and_measured_again(spark):
    own = moment_rows(spark)
    names = spark.createDataFrame([("r", "x", 1, None), ("r", "y", 2, "project")], "record string, name string, seq int, scope string")
    centres = spark.createDataFrame([("r", 0, "x", [1.0, 0.0], "p")], "record string, idx int, label string, centre array<float>, pipeline string")
    none = spark.createDataFrame([], lift.PATCHES)
    now = 10 * numbers.DAY_MS
    limits = replace(DEFAULT, lift_cut=1.0, slip_sessions=2, stumble_sessions=1, reach_min=5)
    voice = lambda asked: {c["name"]: {"text": "when tests fail, stop first"} for c in asked}
    first = lift.run(none, own, names, centres, "p", now, voice, limits=limits)
    patch = first.collect()
    assert len(patch) == 1 and patch[0]["home"] == "x" and patch[0]["state"] == "open" and patch[0]["base_fail"] > 0 and len(patch[0]["history"]) == 1
    assert lift.run(none, own, names, centres, "p", now, lambda asked: {"x": {"text": "stop after 3"}}, limits=limits).count() == 0
    # A later run over a quiet window: nothing is minted twice, and there is an entry more.
    held = spark.createDataFrame(patch, lift.PATCHES)
    again = lift.run(held, own.where("pile = 'ordinary'"), names, centres, "p", now + 1, voice, limits=limits).collect()
    assert len(again) == 1 and [e["fail"] for e in again[0]["history"]][-1] == 0 and len(again[0]["history"]) == 2
    third = lift.run(spark.createDataFrame(again, lift.PATCHES), own.where("pile = 'ordinary'"), names, centres, "p", now + 2, None, limits=limits).collect()
    assert (third[0]["state"], third[0]["via"]) == ("healed", "graduated")
    asleep = lift.run(held.withColumn("pipeline", F.lit("old")), own, names.where("name = 'y'"), centres, "p", now + 1, None, limits=limits).collect()
    assert asleep[0]["state"] == "dormant"
    shown = lift.clauses(held).collect()
    assert [(c["name"], c["clause"]) for c in shown] == [("x", "when tests fail, stop first")]
    assert lift.key_lines(1, {"bounces": 10}, 2, lambda m: "asks", "left") == ["asks", "left"] and lift.key_lines(0, {"bounces": 9}, 2, lambda m: "asks", "left") == []


def test_profile(spark, tmp_path):
    own = moment_rows(spark)
    names = spark.createDataFrame([("r", "x", 1, None), ("r", "y", 2, "project")], "record string, name string, seq int, scope string")
    clauses = spark.createDataFrame([("r", "x", "when tests fail, stop first", 40, None, 1)], "record string, name string, clause string, slip long, trend string, place int")
    voice = lambda asked: {c["name"]: {"section": "Talk", "line": "stop early", "quote": c["candidates"][0]} for c in asked}
    text_ = profile.build(own, names, voice, ["Work", "Talk"], clauses, ["left alone"], built="2026-01-01 10:00 UTC")
    assert "tests fail → stop first" in text_ and "- left alone" in text_ and "From 10 conversations" in text_ and "slipped 40×" in text_ and "# built 2026-01-01" in text_
    assert profile.build(own, names, lambda asked: {}, ["Work", "Talk"]) is None
    for n in (1, 2):
        profile.write(spark, f"# Report {n}", f"file://{tmp_path}/report.md")
    assert (tmp_path / "report.md").read_text() == "# Report 2"


def test_folds_in_the_report():
    rows = [report.Row("a", "Work", "one", 5, 3), report.Row("b", "Work", "two", 9, 3), report.Row("c", "Work", "three", 7, 3)]
    fold = report.Fold("Work", "do it", {"a": "at first", "b": "at last", "c": "then"})
    out = report.assemble(rows, ["Work"], folds=[fold], clauses={"c": report.Clause("when it breaks, mend it", 4)})
    assert out.index("at last (9×)") < out.index("at first (5×)") and "three and when it breaks, mend it" in out and "then" not in out
    assert "do it" not in report.assemble(rows[:1], ["Work"], folds=[fold])


def test_older_moments_are_built_again_from_whole_turns(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    turns = spark.createDataFrame([turn(0, "assistant", "closures capture variables"), turn(1, "user", "one"), turn(2, "user", "two")], TURNS)
    refresh.ingest(store, turns)
    assert store.version("r") == refresh.MOMENTS_VERSION and "closures" in store.read("moments").where("reply = 'one'").first()["ai_terms"]
    store.replace("moments", store.read("moments").withColumn("ai_terms", F.lit(None)).checkpoint())
    store.replace("versions", spark.createDataFrame([(1, "r")], "version int, record string"))
    refresh.ingest(store, turns)
    assert store.read("moments").where("ai_terms is not null").isEmpty() and store.version("r") == 1
    refresh.ingest(store, turns, whole=True)
    assert store.read("moments").count() == 2 and store.read("moments").where("ai_terms is not null").count() == 2
    store.append("assignments", store.read("moments").selectExpr("key", "current_timestamp() at", "array('x') kinds", "1L seq", "record"))
    store.clear_derived("r")
    assert store.read("assignments").isEmpty() and store.read("moments").count() == 2


def test_asks_are_read_only_with_answers(spark):
    own = moment_rows(spark)
    frequencies = spark.createDataFrame([("r", "closure", 5)], "record string, term string, df long")
    assert phrases.asks_read(own, frequencies, 0) is None
    assert phrases.asks_read(own.withColumn("ai_terms", F.array().cast("array<string>")), frequencies, 9) is None
    assert phrases.asks_read(own, frequencies, 9) is not None


def test_when_to_refresh():
    day = numbers.DAY_MS
    assert state.refresh_due(0, None, 0) is None and state.refresh_due(0, 0, 0, by_hand=True) and state.refresh_due(1, None, 0) == "first"
    assert state.refresh_due(1, 0, 6 * day) is None and state.refresh_due(1, 0, 7 * day) and state.refresh_due(1, 0, day, cadence="daily") and state.refresh_due(1, 0, 5, cooldown_ms=5)


def test_sitting(spark):
    from colloquy.plans import consult

    rows = [("r", f"s{i % 4}", i, f"h{i}", "run the tests", "said", False, i, "plain" if i in (3, 5) else None, False, "No, stop that") for i in range(8)]
    own = spark.createDataFrame(rows, "record string, session string, idx int, hash string, prompt string, said string, pasted boolean, ms long, interrupted string, declined boolean, reaction string")
    own = own.withColumn("session", F.when(F.col("interrupted") == "plain", "s9").otherwise(F.col("session")))
    chains = spark.createDataFrame([], "record string, session string, pos int, action string")
    findings = miners.measure(own, chains)
    lesson = findings.where("kind = 'lesson'").first()
    assert [e["hash"] for e in lesson["exemplars"]] == ["h3", "h5"] and lesson["exemplars"][0]["quote"] == "no stop that"
    assert {r["kind"]: r["n"] for r in miners.finding_counts(findings).collect()} == {"lesson": 1, "rule": 1}
    installed = spark.createDataFrame([("old-way", "x", False)], "name string, description string, minted boolean")
    seen = []

    def ask(evidence, notes):
        seen.append((evidence, notes))
        good = {"kind": "skill", "name": "stop-early", "description": "d", "standard": "s", "moves": ["stop"], "citations": [lesson["id"]], "quote": "no stop that"}
        return "Here: " + json.dumps({"proposals": [good, good | {"name": "old-way"}, good | {"quote": "never said"}, "noise"]}) + " done"

    decided, made = consult.sit(findings, installed, ask)
    assert [d["ok"] for d in decided] == [True, False, False] and len(seen[0][0]) == 2 and seen[0][1] == ["old-way — x"]
    (row,) = made.collect()
    assert row["path"] == "stop-early/SKILL.md" and f"- {lesson['id']}: corrections 2 · exchanges 3" in row["content"]
    assert consult.parse("no json") == [] and consult.parse("{broken") == [] and consult.parse('{"proposals": 3}') == []
    assert consult.sit(findings, installed, lambda e, n: None)[0] == []
