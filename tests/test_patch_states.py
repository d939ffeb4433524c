"""Patches on a stream: the states of the batch functions on the same runs, over a restart."""

import json
import random

from pyspark.sql import functions as F

from colloquy.operators import patches
from colloquy.streaming import patch_states as ps

DAY = 86_400_000


def runs(seed=5, n=14):
    """Entries of 40 patches at n runs a week apart, of which each sees some."""
    rng, out = random.Random(seed), []
    for run in range(n):
        at = (run + 1) * 7 * DAY
        for i in range(40):
            mode = 1 + i % 2
            if rng.random() < 0.15:
                continue
            good = i % 5 == 0 and run > 4
            entry = {
                "built_ms": at, "fail": rng.choice([0.0, 0.1, 0.2]) if good else rng.choice([0.5, 0.7, 0.9]), "sessions": 0 if good and i % 10 == 0 or i in (7, 9) else rng.choice([0, 1, 4]),
                "sample": rng.choice([20, 120, 200]) if i % 3 else 150, "reach": rng.choice([0, 3]), "hold": rng.choice([None, 0.5, 1.0]), "refused_rose": rng.choice([None, True, False]), "engage": rng.choice([None, 0.4, 0.6]),
            }
            out.append({"id": f"p{i}", "mode": mode, "born_ms": 0, "base_fail": 0.6, "base_engage": 0.5 if i % 4 == 1 else None, "action": "show" if i % 7 == 0 else None} | entry)
    return out


def test_decisions_are_those_of_the_columns(spark):
    by: dict[str, list[dict]] = {}
    cases = []
    for row in [*runs(1), *runs(2), *runs(3)]:
        history = by.setdefault(row["id"], [])
        history.append({f: row[f] for f in ps.FIELDS})
        history.sort(key=lambda e: e["built_ms"])
        cases.append((f"{len(cases)}", row["mode"], 0, row["base_fail"], row["base_engage"], row["action"], [tuple(e[f] for f in ps.FIELDS) for e in history[-12:]]))
    df = spark.createDataFrame(cases, f"id string, mode int, born_ms long, base_fail double, base_engage double, action string, history array<{patches.ENTRY}>")
    kinds = set()
    for now in (30 * DAY, 100 * DAY, 140 * DAY):
        got = {r["id"]: (r["next_state"], r["via"]) for r in patches.next_state(df, now).collect()}
        want = {c[0]: ps.decide(dict(zip(("mode", "born_ms", "base_fail", "base_engage", "action"), c[1:6])), [dict(zip(ps.FIELDS, e)) for e in c[6]], now) for c in cases}
        assert got == want
        kinds |= set(want.values())
    assert {k[0] for k in kinds} == {"open", "healed", "wrong", "lapsed"} and {k[1] for k in kinds} == {None, "graduated", "closed", "learned"}


def test_stream_and_batch_agree_over_a_restart(spark, tmp_path):
    every = runs()
    times = sorted({r["built_ms"] for r in every})
    schema = f"id string, mode int, born_ms long, base_fail double, base_engage double, action string, history array<{patches.ENTRY}>, state string, via string"
    first = {r["id"]: r for r in reversed(every)}
    open_, ended = {i: (i, r["mode"], 0, r["base_fail"], r["base_engage"], r["action"], [], "open", None) for i, r in first.items()}, {}
    for at in times:  # run after run in batch, each patch from the run that it first appears in
        seen = {r["id"]: r for r in every if r["built_ms"] == at and r["id"] in open_}
        if not seen:
            continue
        own = spark.createDataFrame([open_[i] for i in seen], schema)
        entries = spark.createDataFrame([(i, tuple(r[f] for f in ps.FIELDS)) for i, r in seen.items()], f"id string, entry {patches.ENTRY}")
        judged = patches.next_state(patches.with_entry(own.drop("via"), entries), at)
        for r in judged.select("id", "history", "next_state", "via").collect():
            history = [tuple(e) for e in r["history"]]
            if r["next_state"] == "open":
                open_[r["id"]] = (*open_[r["id"]][:6], history, "open", None)
            else:
                ended[r["id"]] = (r["next_state"], r["via"], at)
                del open_[r["id"]]
    (tmp_path / "runs").mkdir()

    def write(some):
        for at in some:
            (tmp_path / "runs" / f"{at:015d}.json").write_text("\n".join(json.dumps(r) for r in every if r["built_ms"] == at))

    stream = ps.stream_runs(spark, f"{tmp_path}/runs", files_at_once=3)
    for some in (times[:5], times[5:]):  # the query ends and starts again between them
        write(some)
        ps.follow_patches(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("state <> 'open'")
    by_entry = {r["id"]: (r["state"], r["via"], r["built_ms"]) for r in got.collect()}
    assert got.count() == len(by_entry)  # each ends once
    assert {i: x for i, x in by_entry.items() if x[0] != "lapsed"} == {i: x for i, x in ended.items() if x[0] != "lapsed"}
    # A timer may end an ask in the run before the entry that would tell.
    assert {i for i, x in by_entry.items() if x[0] == "lapsed"} >= {i for i, x in ended.items() if x[0] == "lapsed"}
    assert {x[0] for x in ended.values()} >= {"healed", "wrong"} and "lapsed" in {x[0] for x in by_entry.values()}
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("id").agg(F.max("entries").alias("n")).collect()
    assert max(r["n"] for r in last) <= 12
