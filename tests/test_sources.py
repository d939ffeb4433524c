"""Both transcript dialects, on archives built here with known turns."""

import json
import os

import pytest

from colloquy.sources import base, dialect_a, dialect_b


def write(path, rows, mtime):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    os.utime(path, (mtime, mtime))


def a(type_, uuid, content, **more):
    return {"type": type_, "uuid": uuid, "sessionId": "sa", "timestamp": f"2026-01-01T00:00:{len(uuid):02d}Z", "message": {"content": content}} | more


@pytest.fixture
def archive_a(tmp_path):
    tool = lambda i, n, **x: {"type": "tool_use", "id": i, "name": n, "input": x}
    rich = [
        a("user", "u1", "first draft", parentUuid="p"),
        "not json",
        a("user", "u22", [{"type": "text", "text": "final"}, {"type": "text", "text": "draft"}], parentUuid="p"),
        a("assistant", "u333", [{"type": "text", "text": "answer"}, tool("t1", "Read"), tool("t2", "Task", subagent_type="scout"), tool("t3", "Skill", skill="sew"), tool("t4", "Read")]),
        a("user", "u4444", [{"type": "tool_result", "tool_use_id": "t2", "content": "no"}], toolDenialKind="user-rejected"),
        a("user", "u55555", "[Request interrupted by user for tool use]"),
        a("user", "u666666", "[request interrupted by user]"),
        a("user", "u7777777", "<system-reminder>hidden <b></system-reminder>kept <em>text</em>"),
        a("user", "u88888888", "side", isSidechain=True),
        a("user", "u999999999", "meta", isMeta=True),
        a("assistant", "uaaaaaaaaaa", ""),
        a("user", "ubbbbbbbbbbb", [{"type": "image"}, {"type": "image"}]),
        a("user", "", "no id"),
        a("user", "uc", "x" * 2001),
        {"type": "ai-title", "aiTitle": "A title", "sessionId": "sa"},
    ]
    write(tmp_path / "p" / "rich.jsonl", rich, 3000)
    write(tmp_path / "p" / "replay.jsonl", [a("user", "u1", "first draft", parentUuid="p"), a("user", "ud", "other")], 2000)
    write(tmp_path / "machine.jsonl", [a("user", "ue", "machine", entrypoint="sdk-cli"), a("user", "uf", "machine", entrypoint="cli")], 1000)
    return str(tmp_path)


def test_dialect_a(spark, archive_a):
    lines = base.read_lines(spark, archive_a)
    turns = {r["uuid"]: r.asDict() for r in dialect_a.turns(lines).collect()}
    assert set(turns) == {"u22", "u333", "u4444", "u55555", "u666666", "u7777777", "ubbbbbbbbbbb", "", "uc", "ud"}
    assert turns["u22"]["text"] == "final\ndraft" and turns["u22"]["line_no"] == 0
    assert turns["u333"]["tools"] == ["Read", "Task", "Skill", "Read"] and turns["u333"]["delegations"] == ["scout"] and turns["u333"]["skills"] == ["sew"]
    assert (turns["u333"]["delegation_count"], turns["u333"]["skill_count"]) == (1, 1)
    assert turns["u4444"]["denial"] == "user-rejected" and turns["u4444"]["denied_tools"] == ["Task"]
    assert turns["u55555"]["interrupt_kind"] == "tool-use" and turns["u666666"]["interrupt_kind"] == "plain" and turns["u666666"]["text"] == ""
    assert turns["u7777777"]["text"] == "kept  text"
    assert turns["ubbbbbbbbbbb"]["images"] == 2 and turns["uc"]["pasted"] and not turns["ud"]["pasted"]
    assert [r["title"] for r in dialect_a.titles(lines).collect()] == ["A title"]


def test_commands_and_drift(spark, tmp_path):
    run = lambda c: {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": c}}
    write(tmp_path / "s.jsonl", [a("assistant", "u1", [run("git status && ls; git -v\nnpm test")]), a("assistant", "u2", [run("python3 run.py")])], 10)
    write(tmp_path / "copy" / "s.jsonl", [a("assistant", "u3", [run("git push x")])], 10)
    lines = base.read_lines(spark, str(tmp_path))
    chain = sorted((tuple(r["pos"]), r["action"]) for r in dialect_a.command_chain(lines).collect())
    assert [x for _, x in chain] in (["git status", "git", "npm test", "python3 run.py"], ["git push"])
    assert base.drift(lines, dialect_a.turns(lines), least_bytes=1).first()["drifted"]
    assert not base.drift(lines, dialect_a.turns(lines)).first()["drifted"]


def test_dialect_b(spark, tmp_path):
    e = lambda t, **p: {"timestamp": "2026-01-01T00:00:00Z", "type": t, "payload": p}
    call = lambda i, n, text="x": e("response_item", type="function_call", name=n, input=text, call_id=i)
    out = lambda i, o, turn="": e("response_item", type="function_call_output", call_id=i, output=o, internal_chat_message_metadata_passthrough={"turn_id": turn})
    rows = [
        e("session_meta", id="s1", cwd="/w", source="cli", git={"branch": "main"}),
        e("turn_context", approval_policy="on-request"),
        e("event_msg", type="user_message", message=" hi ", images=["i"]),
        e("event_msg", type="agent_message", message="hello"),
        call("c1", "exec", "tools.read_file(1) skills/sew/SKILL.md"),
        out("c1", "rejected by user: no", "t9"),
        e("event_msg", type="turn_aborted", reason="interrupted", turn_id="t9"),
        e("event_msg", type="turn_aborted", reason="replaced", turn_id="t8"),
        call("c2", "shell"),
        out("c2", "rejected by configuration"),
        out("c2", "fine"),
        e("turn_context", approval_policy="never"),
        call("c3", "shell"),
        out("c3", "aborted by user"),
    ]
    write(tmp_path / "b.jsonl", rows, 200)
    write(tmp_path / "fork.jsonl", [e("session_meta", id="s2", forked_from_id="s1", source="cli"), *rows[1:4], e("event_msg", type="user_message", message="new")], 100)
    write(tmp_path / "bot.jsonl", [e("session_meta", id="s3", source="exec"), *rows[1:4]], 300)
    turns = dialect_b.turns(base.read_lines(spark, str(tmp_path))).orderBy("path", "line_no").collect()
    assert [(r["session"], r["role"], r["text"], r["interrupt_kind"], r["denial"]) for r in turns] == [
        ("b:s1", "user", "hi", None, None), ("b:s1", "assistant", "hello", None, None), ("b:s1", "assistant", "", None, None), ("b:s1", "user", "", None, "user-rejected"),
        ("b:s1", "user", "", "tool-use", None), ("b:s1", "assistant", "", None, None), ("b:s1", "user", "", None, "automode-blocked"), ("b:s1", "assistant", "", None, None),
        ("b:s1", "user", "", "plain", None), ("b:s2", "user", "new", None, None),
    ]
    assert turns[2]["tools"] == ["read_file"] and turns[2]["skills"] == ["sew"] and turns[3]["denied_tools"] == ["read_file"] and turns[0]["images"] == 1


def test_registry():
    from pyspark.sql import functions as F  # noqa: F401

    d = [base.SourceDialect("a", ("/x",), dialect_a.turns), base.SourceDialect("b", ("/x/y",), dialect_b.turns)]
    assert [x.record for x in d] == ["a", "b"]


def test_longest_root_wins(spark):
    d = [base.SourceDialect("a", ("/x",), dialect_a.turns), base.SourceDialect("b", ("/x/y",), dialect_b.turns)]
    from pyspark.sql import functions as F

    paths = spark.createDataFrame([("/x/y/1",), ("/x/z",), ("/q",)], "p string")
    assert [r[0] for r in paths.select(base.record_of(F.col("p"), d)).collect()] == ["b", "a", "a"]


def test_compressed_installed_and_archived_files(spark, tmp_path):
    from colloquy.sources import files

    (tmp_path / "live" / "p").mkdir(parents=True)
    (tmp_path / "live" / "p" / "a.jsonl").write_text("{}\n")
    (tmp_path / "live" / "p" / "b.jsonl.zst").write_bytes(b"x")
    root = f"file://{tmp_path}/live"
    assert [r["path"].rsplit("/", 1)[1] for r in files.compressed_files(spark, root).collect()] == ["b.jsonl.zst"]
    target = f"file://{tmp_path}/archive"
    files.archive(spark, root, target)
    files.archive(spark, root, target)
    assert [(r["name"], r["bytes"]) for r in spark.read.parquet(target).collect()] == [("p__a.jsonl", 3)]
    (tmp_path / "live" / "p" / "a.jsonl").write_text("{}\n{}\n")
    files.archive(spark, root, target)
    assert [(r["name"], bytes(r["content"])) for r in files.archived(spark, target).collect()] == [("p__a.jsonl", b"{}\n{}\n")]

    for name, text in (("one", "---\nname: one\ndescription: does\n  one thing\nother: x\n---\nminted here"), ("two", "no head")):
        (tmp_path / "skills" / name).mkdir(parents=True)
        (tmp_path / "skills" / name / "SKILL.md").write_text(text)
    got = files.installed_skills(spark, "minted here", f"file://{tmp_path}/skills").collect()
    assert [(r["name"], r["description"], r["minted"]) for r in got] == [("one", "does one thing", True)]
    (tmp_path / "blocks").mkdir()
    (tmp_path / "blocks" / "house.md").write_text("<!-- note\n\nmore -->\n# Title\n\nThe first\nparagraph.\n\nThe second.")
    (tmp_path / "blocks" / "bare.md").write_text("# Only a title\n")
    got = files.installed_blocks(spark, "minted here", f"file://{tmp_path}/blocks").collect()
    assert [(r["name"], r["description"], r["minted"]) for r in got] == [("house", "The first paragraph.", False)]


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    """Splits far smaller than a file: many tasks, the same rows and numbers."""
    import random

    rng = random.Random(3)
    want = {}
    for name in ("one", "sub/two", "empty"):
        path = tmp_path / f"{name}.jsonl"
        path.parent.mkdir(exist_ok=True)
        lines = ["" if name == "empty" or rng.random() < 0.1 else json.dumps({"n": i, "pad": "é" * rng.randint(0, 300), "cr": "a\\rb"}) for i in range(1 if name == "empty" else 2000)]
        path.write_bytes(("\n".join(lines) + '\n{"torn": tr').encode())
        want |= {(path.name, i): line for i, line in enumerate([*lines, '{"torn": tr']) if line}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = base.read_lines(spark, str(tmp_path), str(tmp_path / "absent"))
        assert spark.read.text(str(tmp_path), recursiveFileLookup=True).rdd.getNumPartitions() > 20
        assert {(r["path"].rsplit("/", 1)[1], r["line_no"]): r["value"] for r in got.collect()} == want
        assert base.read_lines(spark, str(tmp_path), file_cap=100).select("path").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_absent_folders_hold_nothing(spark, tmp_path):
    from colloquy.sources import files

    gone = f"file://{tmp_path}/gone"
    assert base.read_lines(spark, gone).count() == 0 and files.compressed_files(spark, gone).count() == 0
    assert files.installed_skills(spark, "m", gone).count() == 0 and files.installed_blocks(spark, "m", gone, f"{gone}2").count() == 0


def test_recent_read_stops_at_what_it_needs(spark, tmp_path):
    from colloquy.operators.exchanges import recent_exchanges
    from colloquy.sources import recent

    for f in range(16):
        rows = [a("assistant" if i % 2 else "user", f"f{f}-{i}", f"said {i // 2 if f % 5 == 0 else f * 100 + i}", sessionId=f"s{f}", timestamp=f"2026-01-{f % 28 + 1:02d}T{f // 28:02d}:00:{i:02d}Z") for i in range(12)]
        write(tmp_path / "p" / f"file{f:02d}.jsonl", rows, 1000 + f)
    read = []
    dialect = base.SourceDialect("a", (f"file://{tmp_path}",), lambda lines, record: read.append(lines) or dialect_a.turns(lines, record))
    whole = recent.as_exchanges(dialect_a.turns(base.read_lines(spark, str(tmp_path)), "a"))
    columns = ["hash", "session", "idx", "first_of_day"]
    for want in (3, 10_000):
        read.clear()
        got = recent.read_recent(spark, dialect, want, first=8)
        assert [tuple(r) for r in got.select(columns).collect()] == [tuple(r) for r in recent_exchanges(whole, want).select(columns).collect()]
        paths = read[-1].select("path").distinct().count()
        assert paths == (8 if want == 3 else 16)
