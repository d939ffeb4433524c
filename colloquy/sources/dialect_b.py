"""Dialect B: event-sourced envelopes of timestamp, type and payload, with a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import refusal_kind, skill_names, tool_name, trim_white
from .base import TURN_COLUMNS, first_by

FIELDS = "timestamp string, type string, payload string"
PAYLOAD = (
    "type string, id string, session_id string, cwd string, source string, thread_source string, history_mode string, forked_from_id string, "
    "git struct<branch:string>, approval_policy string, message string, images array<string>, reason string, turn_id string, name string, input string, "
    "call_id string, output string, internal_chat_message_metadata_passthrough struct<turn_id:string>"
)
HISTORY, SOURCES = ["legacy", "paginated"], ["cli", "vscode"]
CALLS, OUTPUTS = ["custom_tool_call", "function_call"], ["custom_tool_call_output", "function_call_output"]


def turns(lines: DataFrame, record: str = "b", own_marks: tuple[str, ...] = ()) -> DataFrame:
    """Clean turns of dialect B lines. own_marks: what a text of this system's own contains."""
    rows = lines.withColumn("e", F.from_json("value", FIELDS)).where("e.type is not null").select("path", "mtime", "line_no", "e.*")
    rows = rows.withColumn("p", F.from_json("payload", PAYLOAD))
    order = Window.partitionBy("path").orderBy("line_no")

    heads = rows.where("type = 'session_meta'").withColumn("n", F.row_number().over(order)).where("n = 1")
    heads = heads.where(F.col("p.source").isin(*SOURCES) & (F.coalesce("p.thread_source", F.lit("user")) == "user") & F.coalesce("p.history_mode", F.lit("legacy")).isin(*HISTORY))
    heads = heads.select(
        "path", F.col("line_no").alias("head_line"), F.concat(F.lit(f"{record}:"), F.coalesce("p.id", "p.session_id", F.lit(""))).alias("session"),
        F.coalesce("p.forked_from_id", "p.id", F.lit("")).alias("lineage"), F.col("p.cwd").alias("cwd"), F.col("p.git.branch").alias("git_branch"),
    )
    rows = rows.join(heads, "path").withColumn("policy", F.coalesce(F.last(F.nullif(trim_white(F.when(F.col("type") == "turn_context", F.col("p.approval_policy"))), F.lit("")), ignorenulls=True).over(order), F.lit("")))
    rows = rows.where(~F.col("type").isin("session_meta", "turn_context") & (F.col("line_no") > F.col("head_line")))
    # The place among the other lines is half of an event's identity, before copies go.
    rows = rows.withColumn("index", F.row_number().over(order) - 1)
    made = F.concat(F.col("lineage"), F.lit("#"), F.col("index").cast("string"), F.lit(":"), F.substring(F.sha2("payload", 256), 1, 12))
    rows = rows.withColumn("uuid", F.when(F.coalesce("p.id", F.lit("")) != "", F.concat(F.lit("p:"), "p.id")).otherwise(made))
    rows = first_by(rows, "uuid")

    event, item = F.col("type") == "event_msg", F.col("type") == "response_item"
    call, output = item & F.col("p.type").isin(*CALLS), item & F.col("p.type").isin(*OUTPUTS)
    call_id = F.nullif(trim_white(F.col("p.call_id")), F.lit(""))
    calls = rows.where(call).select("path", F.col("line_no").alias("call_line"), call_id.alias("call_id"), tool_name(F.col("p.name"), F.col("p.input")).alias("called"), F.col("policy").alias("call_policy"))
    refusals = rows.where(output).select("path", "line_no", call_id.alias("call_id")).join(calls, ["path", "call_id"]).where("call_line <= line_no")
    refusals = refusals.groupBy("path", "line_no").agg(F.max_by("called", "call_line").alias("refused"), F.max_by("call_policy", "call_line").alias("call_policy"))
    rows = rows.join(refusals, ["path", "line_no"], "left")

    message = F.coalesce(trim_white(F.col("p.message")), F.lit(""))
    denial = F.when(output, refusal_kind(F.col("p.output")))
    never = (denial == "user-rejected") & (F.coalesce("call_policy", "policy") == "never")
    aborted = event & (F.col("p.type") == "turn_aborted") & (F.col("p.reason") == "interrupted")
    rows = rows.withColumns({"denial": F.when(~F.coalesce(never, F.lit(False)), denial), "plain": F.coalesce(never | aborted, F.lit(False)), "aborted": F.coalesce(aborted, F.lit(False))})
    own_turn = F.coalesce(F.nullif(trim_white(F.col("p.internal_chat_message_metadata_passthrough.turn_id")), F.lit("")), F.lit(None))
    refused_turns = rows.where("denial = 'user-rejected' and refused is not null").select("path", own_turn.alias("abort_turn")).where("abort_turn is not null").distinct().withColumn("was_refused", F.lit(True))
    rows = rows.withColumn("abort_turn", F.when(F.col("aborted"), F.nullif(trim_white(F.col("p.turn_id")), F.lit("")))).join(refused_turns, ["path", "abort_turn"], "left")

    typed, said = event & (F.col("p.type") == "user_message"), event & (F.col("p.type") == "agent_message")
    images = F.when(typed, F.greatest(F.coalesce(F.size("p.images"), F.lit(0)), F.lit(0))).otherwise(0)
    text = F.when(typed | said, message).otherwise("")
    skills = F.when(call, skill_names(F.col("p.input")))
    rows = rows.withColumns({"text": text, "images": images, "skills": F.when(F.size(skills) > 0, skills)})
    keep = typed & ((F.col("text") != "") | (F.col("images") > 0)) | said & (F.col("text") != "") | call | F.col("denial").isNotNull() | F.col("plain")
    rows = rows.where(keep)
    for mark in own_marks:
        rows = rows.where(~(typed & F.col("text").contains(mark)))
    return rows.select(
        F.lit(record).alias("record"), "path", "mtime", "line_no", "uuid", "session", F.coalesce("timestamp", F.lit("")).alias("ts"),
        F.when(said | call, "assistant").otherwise("user").alias("role"), "text", F.col("plain").alias("interrupted"),
        F.when(F.col("plain"), F.when(F.coalesce("was_refused", F.lit(False)), "tool-use").otherwise("plain")).alias("interrupt_kind"),
        (typed & (F.length("text") > DEFAULT.paste_bound)).alias("pasted"), "cwd", "git_branch",
        F.when(call, F.array(tool_name(F.col("p.name"), F.col("p.input")))).alias("tools"), F.lit(None).cast("array<string>").alias("delegations"), "skills",
        F.lit(None).cast("int").alias("delegation_count"), F.when(F.col("skills").isNotNull(), F.size("skills")).alias("skill_count"),
        "denial", F.when(F.col("denial").isNotNull() & F.col("refused").isNotNull(), F.array("refused")).alias("denied_tools"), "images",
    ).select(*TURN_COLUMNS)
