"""Turns on a stream: replays add nothing, late rows join their span of activity."""

import json
import os

from test_operators import turn

from colloquy.streaming import ingest


def files(spark, folder):
    return spark.readStream.schema(ingest.TURNS).option("maxFilesPerTrigger", 1).json(str(folder))


def put(folder, name, rows, at):
    path = folder / f"{name}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (at, at))


def run(stream, name, checkpoint, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def test_replays_add_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [turn(i, "user", f"message {i}", session="s") for i in range(5)]
    put(folder, "one", rows[:3], 1000)
    put(folder, "two", rows, 2000)
    out = ingest.once(files(spark, folder)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True)
    out.start().awaitTermination()
    put(folder, "three", [*rows[2:], turn(9, "user", "new", session="s")], 3000)
    out.start().awaitTermination()  # goes on from its state
    assert sorted(r["pos"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4, 9]


def test_a_late_row_joins_its_span(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda pos, hm, role="user": turn(pos, role, "x", session="s", ts=f"2026-01-01T{hm}:00Z")
    put(folder, "one", [at(0, "10:00"), at(1, "10:40", "assistant"), at(2, "15:00")], 1000)
    put(folder, "two", [at(3, "10:20")], 2000)  # between two spans, which it makes one
    put(folder, "three", [turn(9, "user", "x", session="s", ts="2026-01-09T00:00:00Z")], 3000)  # the watermark passes
    put(folder, "four", [turn(10, "user", "x", session="s", ts="2026-01-09T00:10:00Z")], 4000)
    put(folder, "five", [at(4, "15:10")], 5000)  # too late
    run(ingest.activity(files(spark, folder)), "spans", tmp_path / "c")
    got = sorted((str(r["begin"])[11:16], str(r["end"])[11:16], r["turns"], r["typed"]) for r in spark.table("spans").collect())
    assert got == [("10:00", "11:10", 3, 2), ("15:00", "15:30", 1, 1)]
