"""Messages of agent trajectories: one schema from several layouts, with a reason for what does not fit."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Role names of the layouts and what they mean (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "ai": "assistant", "model": "assistant", "function": "tool", "observation": "tool", "developer": "system"}
KNOWN = frozenset(("user", "assistant", "system", "tool"))
NORMAL = T.StructType([T.StructField("id", T.StringType()), T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))), T.StructField("reason", T.StringType())])


class Unfit(ValueError):
    """A message that no rule reads; the text names the reason."""


def decoded(value, depth: int = 2):
    """JSON that was encoded up to ``depth`` times; other text stays text."""
    for _ in range(depth):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value)
        except ValueError:
            break
    return value


def flat(content) -> str:
    """Visible text of a content field: text, a list of blocks, or nothing; an unknown block is unfit."""
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(t for t in map(flat, content) if t)
    if isinstance(content, dict):
        kind = content.get("type", "text")
        if kind in ("text", "input_text", "output_text"):
            return str(content.get("text", ""))
        if kind == "tool_use":
            return call_text(content.get("name"), content.get("input"))
        if kind == "tool_result":
            return flat(content.get("content"))
    raise Unfit("unknown_block")


def call_text(name, arguments) -> str:
    return f"<tool_call>{json.dumps({'name': name, 'arguments': decoded(arguments)}, sort_keys=True)}</tool_call>"


def message(raw: dict) -> tuple[str, str]:
    """(role, content) with tool calls as canonical tags after the text."""
    said = raw.get("role") or raw.get("from") or ""
    role = ROLES.get(said, said)
    if role not in KNOWN:
        raise Unfit("unknown_role")
    parts = [flat(raw["content"] if "content" in raw else raw.get("value"))]
    for call in raw.get("tool_calls") or []:
        own = call.get("function", call)
        parts.append(call_text(own.get("name"), own.get("arguments")))
    return role, "\n".join(p for p in parts if p)


def trajectory(row: dict) -> list[tuple[str, str]]:
    """The messages of a row, whatever field holds them; query, tools and answers make three."""
    for name in ("messages", "conversations", "trajectory", "turns"):
        if row.get(name):
            found = decoded(row[name])
            if not isinstance(found, list):
                raise Unfit("not_a_list")
            return [message(m) for m in found]
    if "query" in row and "answers" in row:
        calls = decoded(row["answers"])
        tools = [("system", json.dumps(decoded(row["tools"]), sort_keys=True))] if row.get("tools") else []
        return [*tools, ("user", row["query"]), ("assistant", "\n".join(call_text(c.get("name"), c.get("arguments")) for c in calls))]
    raise Unfit("no_messages")


def read(text: str | None) -> tuple[list[tuple[str, str]], str | None]:
    """Messages of a JSON row, or the reason why there are none."""
    try:
        found = trajectory(json.loads(text or ""))
    except Unfit as e:
        return [], str(e)
    except (ValueError, TypeError, AttributeError, KeyError):
        return [], "malformed"
    if not any(role == "assistant" for role, _ in found):
        return [], "no_answer"
    return found, None


def normalized(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, messages, reason) of raw JSON rows."""
    source = rows.selectExpr(f"cast(`{id_col}` AS string) AS id", f"`{json_col}` AS raw")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
        for batch in batches:
            found = [read(x) for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([[{"role": r, "content": c} for r, c in m] for m, _ in found], kind), pa.array([why for _, why in found], pa.string())], names=["id", "messages", "reason"])

    return source.mapInArrow(work, NORMAL)


def commands(text: str) -> list[str]:
    """Commands of fenced shell and SQL blocks, continued lines joined, comments and prompts left out; in order, once each."""
    out: list[str] = []
    for m in re.finditer(r"```(sh|bash|shell|sql)\s*\n(.*?)```", text, re.S):
        body = m[2].replace("\\\n", " ")
        parts = body.split(";") if m[1] == "sql" else body.splitlines()
        for part in parts:
            line = " ".join(re.sub(r"^\s*\$ ", "", part).split())
            if line and not line.startswith(("#", "--")) and line not in out:
                out.append(line)
    return out


def need(text: str, marker: str) -> str:
    """What follows the last marker on its line."""
    at = text.rfind(marker)
    return text[at + len(marker) :].split("\n", 1)[0].strip() if at >= 0 else text.strip()


def earliest(record: list[str], steps: list[str]) -> int | None:
    """The first step that has one of the record's phrases as whole words."""
    for k, step in enumerate(steps):
        if any(re.search(rf"(?<!\w){re.escape(p)}(?!\w)", step) for p in record if p):
            return k
    return None


def faults(messages: list[tuple[str, str]], times: list[int]) -> list[str]:
    """What is wrong with a transcript: calls without results, results without calls, time that runs back, empty turns."""
    found, open_ = [], 0
    for k, (role, content) in enumerate(messages):
        calls = content.count("<tool_call>")
        if role == "tool":
            found += ["result_without_call"] if not open_ else []
            open_ = max(0, open_ - 1)
        elif open_ and role == "user":
            found.append("call_without_result")
            open_ = 0
        open_ += calls if role == "assistant" else 0
        if not content.strip():
            found.append("empty")
        if k and times[k] < times[k - 1]:
            found.append("time_runs_back")
    return found + (["call_without_result"] if open_ else [])
