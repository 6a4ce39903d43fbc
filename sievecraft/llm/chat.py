"""Chat formatting with loss masks found by incremental black-box rendering.

A template is any callable from turns [(role, text)] to a string. Rendering successive
prefixes and comparing consecutive outputs shows where each turn lies; two probes that
differ in the last text alone show where its content starts and ends. A template whose
output for a + b is always that for a and that for b says so by `concatenative = True`.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

_LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {v: k for k, v in _LABELS.items()}
_ESCAPED = re.compile(r"\\(.)", re.S)
_CONTROL = re.compile(r"\\|###|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str) -> str:
    r"""Puts \ before \, ### and </turn>."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class TurnTemplate:
    """`### Role: text</turn>` a turn. Other roles than the three are written as @role."""

    concatenative = True

    def __call__(self, turns: Turns) -> str:
        return "".join(f"### {self.label(role)}: {escape(text)}</turn>\n" for role, text in turns)

    @staticmethod
    def label(role: str) -> str:
        return _LABELS.get(role) or "@" + escape(role).replace(":", "\\:")

    @staticmethod
    def read(output: str) -> Turns:
        """The turns of an output."""
        turns, at = [], 0
        while at < len(output):
            m = _TURN.match(output, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            label = m[1]
            turns.append((_ROLES.get(label) or unescape(label[1:]), unescape(m[2])))
            at = m.end()
        return turns


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def locate(template: Template, turns: Turns) -> tuple[str, list[dict]]:
    """The output for all turns, and for each its span, its content's span and whether it rewrote what stood before.

    start and end hold in the output after this turn; where a later turn rewrites history
    (rewrites is true there), earlier spans don't hold for the final output.
    """
    spans, before = [], template([])
    for i in range(len(turns)):
        after = template(turns[: i + 1])
        same = _common(before, after)
        ones = [template([*turns[:i], (turns[i][0], probe)]) for probe in ("a", "b")]
        lead, tail = _common(*ones), _common(ones[0][::-1], ones[1][::-1])
        spans.append({"start": same, "end": len(after), "content_start": lead, "content_end": len(after) - tail, "rewrites": same < len(before)})
        before = after
    return before, spans


def final_contents(template: Template, turns: Turns, output: str, spans: list[dict]) -> list[tuple[int, int]]:
    """Where each turn's content lies in the final output; an empty span where the output doesn't depend on its text.

    Turns before any change of history keep their spans, others are probed in the whole conversation.
    """
    out, untouched = [], len(output)
    for i in range(len(turns) - 1, -1, -1):
        start, end = spans[i]["content_start"], spans[i]["content_end"]
        if untouched < end:
            ones = [template([*turns[:i], (turns[i][0], probe), *turns[i + 1 :]]) for probe in ("a", "b")]
            start = _common(*ones)
            end = start if ones[0] == ones[1] else len(output) - _common(ones[0][::-1], ones[1][::-1])
        out.append((start, end))
        untouched = min(untouched, spans[i]["start"])
    return out[::-1]


#: Turns whose prefixes are rendered together where the template is concatenative; keeps the work linear in a long conversation.
BLOCK = 32


def format_conversations(df: DataFrame, template: Template, read: Callable[[str], Turns], unescaped: Callable[[str], str], keep: bool = False, block: int = BLOCK) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text) rows.

    Rows go by turn, then role and text; null texts and roles are empty, a null conv_id is
    one more conversation, repeated rows are repeated turns. The turns come to a task
    sorted and are read as a stream. A template that declares itself concatenative renders
    `block` turns at a time, so a conversation of any length takes bounded memory; any other
    renders the prefixes of whole conversations, which takes quadratic time. Gives conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites (whether the
    template rewrote history) and, on request, output and loss_spans (start and end pairs in it, for conversations that fit memory).
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean" + ", output string, loss_spans array<array<long>>" * keep

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None
        blocks = getattr(template, "concatenative", False)

        def flush(s: dict) -> None:
            output, spans = locate(template, s["turns"])
            contents = final_contents(template, s["turns"], output, spans)
            for x, (start, end), (role, _) in zip(spans, contents, s["turns"], strict=True):
                s["rewrites"] |= x["rewrites"]
                if role == "assistant":
                    text = unescaped(output[start:end])
                    s["loss"] += len(text)
                    s["loss_sha"].update(text.encode())
                    if keep:
                        s["spans"].append([s["chars"] + start, s["chars"] + end])
            for role, text in read(output):
                s["n"] += 1
                s["sha"].update(f"{role}\n{text}\n".encode())
            s["chars"] += len(output)
            if keep:
                s["out"].append(output)
            s["turns"] = []

        def done(s: dict) -> tuple:
            if s["turns"]:
                flush(s)
            return (s["id"], s["n"], s["sha"].hexdigest(), s["loss"], s["loss_sha"].hexdigest(), s["chars"], s["rewrites"], *(("".join(s["out"]), s["spans"]) if keep else ()))

        columns = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            rows = []
            for conv, has, role, text in zip(frame["conv_id"], frame["has"], frame["role"], frame["text"], strict=True):
                key = int(conv) if has else None
                if state is None or state["id"] != key:
                    if state is not None:
                        rows.append(done(state))
                    state = {"id": key, "n": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "rewrites": False, "turns": [], "out": [], "spans": []}
                state["turns"].append((role, text))
                if blocks and len(state["turns"]) >= block:
                    flush(state)
            if rows:
                yield _frame(rows, columns)
        if state is not None:
            yield _frame([done(state)], columns)

    rows = df.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNotNull().alias("has"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(partitions(df.sparkSession), "conv_id", "has").sortWithinPartitions("has", "conv_id", "turn", "role", "text").mapInPandas(run, schema)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out
