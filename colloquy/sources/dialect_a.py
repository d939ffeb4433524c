"""Dialect A: one JSON object a line, message content either a text or a list of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import interrupt_kind, strip_wrappers
from .base import TURN_COLUMNS, first_by

FIELDS = (
    "type string, uuid string, parentUuid string, sessionId string, timestamp string, entrypoint string, isSidechain boolean, isMeta boolean, "
    "isCompactSummary boolean, cwd string, gitBranch string, toolDenialKind string, imagePasteIds array<string>, aiTitle string"
)
BLOCKS = "array<struct<type:string,text:string,name:string,id:string,tool_use_id:string,input:struct<subagent_type:string,skill:string,command:string>>>"
AGENT_TOOLS, SKILL_TOOLS, MACHINE = ["Task", "Agent"], ["Skill"], "sdk-cli"


def parse_lines(lines: DataFrame) -> DataFrame:
    """The lines that are JSON, with their fields, and content as text or blocks. A line is parsed once, to a variant."""
    own = lines.withColumn("v", F.try_parse_json("value")).where("v is not null").drop("value")
    fields = {n: F.try_variant_get("v", f"$.{n}", kind) for n, kind in (f.split(" ") for f in FIELDS.split(", "))}
    content = "$.message.content"
    is_list = F.coalesce(F.schema_of_variant(F.try_variant_get("v", content, "variant")).startswith("ARRAY"), F.lit(False))
    own = own.withColumns(fields | {"blocks": F.when(is_list, F.try_variant_get("v", content, BLOCKS)), "said": F.when(~is_list, F.try_variant_get("v", content, "string"))})
    return own.withColumn("raw", F.coalesce(F.when(is_list, text_of(F.col("blocks"))).otherwise(F.col("said")), F.lit(""))).drop("v", "said")


def text_of(blocks: Column) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def tool_uses(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: (b["type"] == "tool_use") & b["name"].isNotNull())


def _some(names: Column) -> Column:
    return F.when(F.size(names) > 0, names)


def human_files(rows: DataFrame) -> DataFrame:
    """Without files whose first entry point is a machine's."""
    first = rows.where(F.col("entrypoint").isNotNull()).groupBy("path").agg(F.min_by("entrypoint", "line_no").alias("first_entry"))
    return rows.join(first.where(F.col("first_entry") == MACHINE), "path", "left_anti")


def denied_tools(rows: DataFrame) -> DataFrame:
    """path, line_no, denied_tools: the tools, called before in the file, whose results are denied."""
    calls = rows.where("type = 'assistant'").select("path", F.col("line_no").alias("call_line"), F.explode(tool_uses(F.col("blocks"))).alias("u"))
    calls = calls.select("path", "call_line", F.col("u.id").alias("tool_use_id"), F.col("u.name").alias("name")).where("tool_use_id is not null")
    results = F.filter("blocks", lambda b: (b["type"] == "tool_result") & b["tool_use_id"].isNotNull())
    asked = rows.where("toolDenialKind is not null").select("path", "line_no", F.posexplode(results).alias("pos", "b")).select("path", "line_no", "pos", "b.tool_use_id")
    found = asked.join(calls, ["path", "tool_use_id"]).where(F.col("call_line") <= F.col("line_no"))
    found = found.groupBy("path", "line_no", "pos").agg(F.max_by("name", "call_line").alias("name"))
    return found.groupBy("path", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("denied_tools"))


def turns(lines: DataFrame, record: str = "a", own_marks: tuple[str, ...] = ()) -> DataFrame:
    """Clean turns of dialect A lines.

    own_marks: beginnings of texts that this system wrote itself, which are no turns.
    """
    rows = human_files(parse_lines(lines))
    rows = rows.where(F.col("type").isin("user", "assistant"))
    for flag in ("isSidechain", "isMeta", "isCompactSummary"):
        rows = rows.where(~F.coalesce(flag, F.lit(False)))
    rows = rows.where(~F.coalesce(F.col("entrypoint") == MACHINE, F.lit(False)))
    denied = denied_tools(rows)  # before replays go
    rows = first_by(rows, "uuid")
    for mark in own_marks:
        rows = rows.where(~F.col("raw").startswith(mark))
    human, uses = F.col("type") == "user", tool_uses(F.col("blocks"))
    kind = F.when(human, interrupt_kind(F.col("raw")))
    images = F.size(F.filter("blocks", lambda b: b["type"] == "image"))
    rows = rows.withColumns(
        {
            "interrupted": kind.isNotNull(), "interrupt_kind": kind, "text": F.when(kind.isNotNull(), "").otherwise(strip_wrappers(F.col("raw"))),
            "tools": F.when(~human, _some(F.transform(uses, lambda u: u["name"]))),
            "delegations": F.when(~human, _some(F.filter(F.transform(F.filter(uses, lambda u: u["name"].isin(*AGENT_TOOLS)), lambda u: u["input"]["subagent_type"]), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))),
            "skills": F.when(~human, _some(F.filter(F.transform(F.filter(uses, lambda u: u["name"].isin(*SKILL_TOOLS)), lambda u: u["input"]["skill"]), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))),
            "images": F.when(images > 0, images).otherwise(F.greatest(F.coalesce(F.size("imagePasteIds"), F.lit(0)), F.lit(0))),
        }
    )
    count = lambda names: F.size(F.filter("tools", lambda t: t.isin(*names)))
    rows = rows.withColumns({"delegation_count": F.when(F.col("tools").isNotNull(), count(AGENT_TOOLS)), "skill_count": F.when(F.col("tools").isNotNull(), count(SKILL_TOOLS))})
    rows = rows.where((F.col("text") != "") | F.col("interrupted") | F.col("toolDenialKind").isNotNull() | F.col("tools").isNotNull() | (F.col("images") > 0))
    rows = rows.join(denied, ["path", "line_no"], "left")
    out = rows.select(
        F.lit(record).alias("record"), "path", "mtime", "line_no", F.coalesce("uuid", F.lit("")).alias("uuid"), F.coalesce("sessionId", F.lit("")).alias("session"),
        F.coalesce("timestamp", F.lit("")).alias("ts"), F.col("type").alias("role"), "text", "interrupted", "interrupt_kind",
        (F.length("text") > DEFAULT.paste_bound).alias("pasted"), "cwd", F.col("gitBranch").alias("git_branch"), "tools", "delegations", "skills",
        "delegation_count", "skill_count", F.col("toolDenialKind").alias("denial"), "denied_tools", "images", "parentUuid",
    )
    return collapse_drafts(out).select(*TURN_COLUMNS)


def collapse_drafts(turns: DataFrame) -> DataFrame:
    """Of typed messages of one parent the last one, at the place of the first."""
    draft = (F.col("role") == "user") & (F.col("text") != "") & (F.coalesce("parentUuid", F.lit("")) != "")
    same = Window.partitionBy("path", "session", "parentUuid")
    drafts = turns.where(draft).withColumns({"__last": F.row_number().over(same.orderBy(F.desc("line_no"))), "line_no": F.min("line_no").over(same)})
    return drafts.where("__last = 1").drop("__last").unionByName(turns.where(~draft))


def titles(lines: DataFrame, record: str = "a") -> DataFrame:
    own = parse_lines(lines).where("type = 'ai-title' and coalesce(aiTitle, '') <> '' and coalesce(sessionId, '') <> ''")
    return own.select(F.lit(record).alias("record"), F.col("sessionId").alias("session"), F.col("aiTitle").alias("title"))


def command_chain(lines: DataFrame, tool: str = "Bash", record: str = "a", roots: tuple[str, ...] = ()) -> DataFrame:
    """record, session (file name), pos, action: the verbs of shell commands, in order.

    A file name counts once: the one below the first of the roots, of those the least path.
    """
    from ..functions.text import command_verb

    named = lines.withColumn("session", F.element_at(F.split("path", "/"), -1))
    place = F.lit(len(roots))
    for i, root in reversed(list(enumerate(roots))):
        place = F.when(F.col("path").contains(root.removeprefix("file://").rstrip("/") + "/"), i).otherwise(place)
    one = named.groupBy("session").agg(F.min_by("path", F.struct(place, "path")).alias("path"))
    own = parse_lines(named.where(F.col("value").contains(f'"{tool}"')).join(one, ["session", "path"], "left_semi"))
    uses = own.select("session", "line_no", F.posexplode(F.filter(tool_uses(F.col("blocks")), lambda u: u["name"] == tool)).alias("use", "u"))
    parts = uses.select("session", "line_no", "use", F.posexplode(F.split("u.input.command", "&&|;|\n")).alias("part", "command"))
    verbs = parts.select(F.lit(record).alias("record"), "session", F.struct("line_no", "use", "part").alias("pos"), command_verb(F.col("command")).alias("action"))
    return verbs.where("action is not null")
