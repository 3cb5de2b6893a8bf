"""Conversations, tools and agents on the driver, and conversation logs as tables."""

from __future__ import annotations

import ast
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.functions.text import token_estimate

# --- logs as tables: (session, seq, role, content, tool_name, error) ---


def last_messages(log: DataFrame, n: int, session: str = "session", seq: str = "seq") -> DataFrame:
    """The last ``n`` messages of each session, in order."""
    w = Window.partitionBy(session).orderBy(F.desc(seq))
    return log.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def token_estimates(log: DataFrame, session: str = "session") -> DataFrame:
    """(session, messages, tokens) of each session."""
    return log.groupBy(session).agg(F.count("*").alias("messages"), token_estimate(F.col("content")).alias("tokens"))


def transcript(log: DataFrame, role: str = "assistant", session: str = "session", seq: str = "seq") -> DataFrame:
    """(session, text): the contents of one role in order."""
    rows = log.where(F.col("role") == role).groupBy(session).agg(F.array_sort(F.collect_list(F.struct(seq, "content"))).alias("m"))
    return rows.select(session, F.array_join(F.transform("m", lambda x: x["content"]), "").alias("text"))


# --- sessions ---


@dataclass(frozen=True)
class Message:
    role: str
    content: str | None
    timestamp: int
    tool_name: str | None = None
    error: str | None = None


@dataclass(frozen=True)
class Session:
    id: str = "session"
    messages: tuple[Message, ...] = ()
    context: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)
    created_at: int = field(default_factory=lambda: int(time.time() * 1000))

    def add_message(self, role: str, content: str, **more) -> Session:
        return replace(self, messages=(*self.messages, Message(role, content, int(time.time() * 1000), **more)))

    def add_tool_result(self, tool: str, result: Any = None, error: str | None = None) -> Session:
        text = None if error else result if isinstance(result, str) else json.dumps(result, default=str)
        return self.add_message("tool", text if error is None else f"Error: {error}", tool_name=tool, error=error)

    def set_context(self, key: str, value: Any) -> Session:
        return replace(self, context=self.context | {key: value})

    def merge_context(self, values: dict[str, Any]) -> Session:
        return replace(self, context=self.context | values)

    def get_context(self, key: str, default: Any = None) -> Any:
        return self.context.get(key, default)

    def message_count(self) -> int:
        return len(self.messages)

    def last_messages(self, n: int) -> list[Message]:
        return list(self.messages[-n:]) if n > 0 else []

    def clear_messages(self) -> Session:
        return replace(self, messages=())

    def to_llm_messages(self) -> list[dict[str, Any]]:
        return [{"role": m.role, "content": m.content} | ({"tool_name": m.tool_name} if m.tool_name else {}) for m in self.messages]

    def token_estimate(self) -> int:
        return sum(len(m.content or "") for m in self.messages) // 4

    def to_table(self, spark) -> DataFrame:
        rows = [(self.id, n, m.role, m.content, m.timestamp, m.tool_name, m.error) for n, m in enumerate(self.messages)]
        return spark.createDataFrame(rows, "session string, seq int, role string, content string, ts long, tool_name string, error string")


# --- tools ---


class ToolError(Exception):
    """A tool was called wrongly or isn't there."""


@dataclass(frozen=True)
class Tool:
    """A named function ``run(args, context)`` with a JSON schema of its parameters."""

    name: str
    description: str
    parameters: dict[str, Any]
    run: Callable[[dict, dict], Any]

    def missing(self, args: dict) -> list[str]:
        return [n for n in self.parameters.get("required", []) if n not in args]

    def execute(self, args: dict, context: dict | None = None) -> Any:
        if lost := self.missing(args):
            raise ToolError(f"missing_{lost[0]}")
        return self.run(args, context or {})

    def to_spec(self) -> dict[str, Any]:
        return {"name": self.name, "description": self.description, "parameters": self.parameters}


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, *tools: Tool) -> Registry:
        self.tools |= {t.name: t for t in tools}
        return self

    def unregister(self, name: str) -> Registry:
        self.tools.pop(name, None)
        return self

    def get(self, name: str) -> Tool:
        if name not in self.tools:
            raise ToolError(f"tool_not_found: {name}")
        return self.tools[name]

    def names(self) -> list[str]:
        return list(self.tools)

    def count(self) -> int:
        return len(self.tools)

    def has_tool(self, name: str) -> bool:
        return name in self.tools

    def filter(self, keep: Callable[[Tool], bool]) -> Registry:
        return Registry({n: t for n, t in self.tools.items() if keep(t)})

    def execute(self, name: str, args: dict, context: dict | None = None) -> Any:
        return self.get(name).execute(args, context)

    def format_for_llm(self) -> list[dict[str, Any]]:
        return [t.to_spec() for t in self.tools.values()]


def _schema(required: dict[str, str], **optional: str) -> dict[str, Any]:
    return {"type": "object", "properties": {n: {"type": t} for n, t in (required | optional).items()}, "required": list(required)}


def search_tool() -> Tool:
    """Searches with the context's ``search_fn(query, options)``; without one finds nothing."""

    def run(args, context):
        find = context.get("search_fn")
        return [] if find is None else find(args["query"], {"limit": args.get("limit", 10), "source_filter": args.get("source_filter")})

    return Tool("search_repos", "Search the indexed sources.", _schema({"query": "string"}, limit="integer", source_filter="string"), run)


def read_file_tool() -> Tool:
    """Reads a file, or what the context's ``read_fn(path)`` gives; optionally some lines, counted from 1, both ends included."""

    def run(args, context):
        read = context.get("read_fn") or (lambda p: Path(p).read_text(encoding="utf-8"))
        text = read(args["path"])
        first, last = args.get("start_line"), args.get("end_line")
        if first is None and last is None:
            return text
        lines = text.split("\n")
        return "\n".join(lines[max(0, (first or 1) - 1) : last if last is not None else len(lines)])

    return Tool("read_file", "Read a file or a range of its lines.", _schema({"path": "string"}, start_line="integer", end_line="integer"), run)


def context_tool() -> Tool:
    """What the context's ``context_fn(name)`` knows of a repository; without one just its name."""

    def run(args, context):
        known = context.get("context_fn")
        return {"name": args["repo_name"]} if known is None else known(args["repo_name"])

    return Tool("get_repo_context", "Get what is known of a repository.", _schema({"repo_name": "string"}, include_files="boolean"), run)


def analyze_code(code: str, language: str = "elixir") -> dict[str, Any]:
    """Modules and functions of code: Python by its syntax tree, Elixir by patterns (an approximation); others only by length."""
    out: dict[str, Any] = {"language": language, "modules": [], "functions": [], "raw_length": len(code), "parse_error": False}
    if language == "python":
        try:
            tree = ast.parse(code)
        except SyntaxError:
            return out | {"parse_error": True}
        out["modules"] = [n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]
        out["functions"] = [{"name": n.name, "arity": len(n.args.args), "type": "def"} for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    elif language == "elixir":
        out["modules"] = re.findall(r"^\s*defmodule\s+([\w.]+)", code, re.M)
        seen: dict[tuple, None] = {}
        for kind, name, args in re.findall(r"^\s*(defp?)\s+([a-z_]\w*[?!]?)\s*(?:\(([^)]*)\))?", code, re.M):
            depth, arity = 0, 1 if args.strip() else 0
            for c in args:
                depth += (c in "([{<") - (c in ")]}>")
                arity += c == "," and depth == 0
            seen[(name, arity, kind)] = None
        out["functions"] = [{"name": n, "arity": a, "type": k} for n, a, k in seen]
        words = re.findall(r"\b(?:do|fn|end)\b(?!:)", re.sub(r'"[^"]*"|#.*', "", code))
        out["parse_error"] = sum(w != "end" for w in words) != sum(w == "end" for w in words)
    return out | {"module_count": len(out["modules"]), "function_count": len(out["functions"])}


def analyze_code_tool() -> Tool:
    def run(args, context):
        return (context.get("analyze_fn") or analyze_code)(args["code"], args.get("language", "elixir"))

    return Tool("analyze_code", "List modules and functions of code.", _schema({"code": "string"}, language="string"), run)


# --- agents ---


@dataclass
class Agent:
    """Asks a text function until it answers without calling a tool.

    An answer that is as a whole a JSON object with a string ``tool`` is a call; missing ``args`` are none.
    """

    generate: Callable[[str], str]
    registry: Registry = field(default_factory=Registry)
    session: Session = field(default_factory=Session)
    max_iterations: int = 10

    @staticmethod
    def parse_tool_call(answer: str) -> tuple[str, dict] | None:
        try:
            data = json.loads(answer)
        except ValueError:
            return None
        if isinstance(data, dict) and isinstance(data.get("tool"), str):
            return data["tool"], data.get("args") or {}
        return None

    def execute_tool(self, name: str, args: dict) -> Any:
        return self.registry.execute(name, args, self.session.context)

    def with_context(self, values: dict[str, Any]) -> Agent:
        self.session = self.session.merge_context(values)
        return self

    def process(self, text: str) -> str:
        """One answer without tools."""
        self.session = self.session.add_message("user", text)
        answer = self.generate(json.dumps(self.session.to_llm_messages()))
        self.session = self.session.add_message("assistant", answer)
        return answer

    def process_with_tools(self, text: str) -> str:
        self.session = self.session.add_message("user", text)
        for _ in range(self.max_iterations):
            answer = self.generate(json.dumps({"tools": self.registry.format_for_llm(), "messages": self.session.to_llm_messages()}))
            call = self.parse_tool_call(answer)
            if call is None:
                self.session = self.session.add_message("assistant", answer)
                return answer
            try:
                self.session = self.session.add_tool_result(call[0], self.execute_tool(*call))
            except Exception as error:  # noqa: BLE001
                self.session = self.session.add_tool_result(call[0], error=str(error))
        raise RuntimeError("max_iterations_exceeded")

    def history(self) -> list[Message]:
        return list(self.session.messages)

    def clear_history(self) -> Agent:
        self.session = self.session.clear_messages()
        return self
