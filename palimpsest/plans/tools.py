"""Replies to tool calls: JSON in, JSON out, and nothing uncleaned on any failure.

The strings of a payload are exploded into rows, cleaned or restored as any other text, and put back in their places. Keys,
numbers, booleans and nulls are left as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.functions.text import PLACEHOLDER
from palimpsest.operators.vault import Vault
from palimpsest.plans.clean import clean, restore
from palimpsest.shared import spread

#: What is said instead of a result that couldn't be cleaned, or of an input that couldn't be restored. Never the reason.
WITHHELD = "The tool result was withheld: it could not be cleaned."
REFUSED = "The tool call was refused: its placeholders could not be restored."


def strings(value: Any, found: list[str]) -> None:
    """Appends all strings of a JSON value, in order; keys aren't among them."""
    if isinstance(value, str):
        found.append(value)
    elif isinstance(value, list):
        for v in value:
            strings(v, found)
    elif isinstance(value, dict):
        for v in value.values():
            strings(v, found)


def put(value: Any, new: Callable[[], str]) -> Any:
    """The value with its strings replaced in order."""
    if isinstance(value, str):
        return new()
    if isinstance(value, list):
        return [put(v, new) for v in value]
    return {k: put(v, new) for k, v in value.items()} if isinstance(value, dict) else value


def _parsed(payload: str | None) -> tuple[Any, list[str] | None]:
    """A JSON text's value and all its strings; no strings where it is no JSON."""
    out: list[str] = []
    try:
        value = json.loads(payload)
        strings(value, out)
    except (TypeError, ValueError, RecursionError):
        return None, None
    return value, out


def _written(payload: str | None, nth: Iterable[int] | None, new: Iterable[str] | None) -> str | None:
    """The payload with its strings of some places replaced."""
    value, own = _parsed(payload)
    if own is None:
        return None
    for n, text in zip(() if nth is None else nth, () if new is None else new, strict=True):
        own[n] = text
    return json.dumps(put(value, iter(own).__next__), ensure_ascii=False)


def _rows(payloads: DataFrame, column: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Strings of JSON payloads (id, column) as (id, nth, doc_id, text), and how those that were rewritten go back into them.

    A payload that is no JSON has no strings and comes back as null: what can't be read is never handed on.
    """

    @F.pandas_udf("array<string>")
    def read(j: pd.Series) -> pd.Series:
        return j.map(lambda p: _parsed(p)[1])

    @F.pandas_udf("string")
    def write(j: pd.Series, nth: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([_written(*x) for x in zip(j, nth, new, strict=True)], dtype=object)

    texts = spread(payloads.select("id", column)).select("id", F.posexplode(read(column)).alias("nth", "text")).withColumn("doc_id", F.struct("id", "nth"))

    def back(done: DataFrame) -> DataFrame:
        each = done.groupBy("id").agg(F.collect_list(F.struct("nth", "text")).alias("s"))
        return payloads.join(each, "id", "left").withColumn(column, write(column, F.col("s.nth"), F.col("s.text"))).drop("s")

    return texts, back


def clean_json(payloads: DataFrame, config: Config, store: Vault | None = None, column: str = "payload") -> DataFrame:
    """payloads (id, column of JSON) with every string cleaned. Ids are unique. A payload that is no JSON becomes null."""
    texts, back = _rows(payloads, column)
    return back(clean(texts, config, store).where("replaced > 0"))


def restore_json(payloads: DataFrame, store: Vault, column: str = "payload") -> DataFrame:
    texts, back = _rows(payloads, column)
    return back(restore(texts, store, marked=True))


def reply_after(spark: SparkSession, message: str, config: Config, store: Vault) -> str | None:
    """The reply to a tool's result: the cleaned result, nothing where there is none, a block on any failure."""
    try:
        result = json.loads(message).get("tool_result")
        if result is None:
            return None
        df = spark.createDataFrame([(0, json.dumps(result, ensure_ascii=False))], "id int, payload string")
        cleaned = json.loads(clean_json(df, config, store).first().payload)
        return json.dumps({"hookSpecificOutput": {"hookEventName": "PostToolUse", "updatedToolOutput": cleaned}}, ensure_ascii=False)
    except Exception as e:  # fail closed: the model gets neither the result nor the reason, the user is told
        return json.dumps({"hookSpecificOutput": {"hookEventName": "PostToolUse", "updatedToolOutput": WITHHELD}, "decision": "block", "reason": WITHHELD, "systemMessage": f"a tool result was withheld: {type(e).__name__}"})


def reply_before(spark: SparkSession, message: str, store: Vault) -> str | None:
    """The reply to a tool's input: the restored input, nothing where it holds no placeholder, a denial on any failure."""
    try:
        given = json.loads(message).get("tool_input")
        text = json.dumps(given, ensure_ascii=False)
        if given is None or not re.search(PLACEHOLDER, text):
            return None
        df = spark.createDataFrame([(0, text)], "id int, payload string")
        unknown = restore(_rows(df, "payload")[0], store).agg(F.sum("unknown")).first()[0]
        reply = {"hookSpecificOutput": {"hookEventName": "PreToolUse", "permissionDecision": "allow", "updatedInput": json.loads(restore_json(df, store).first().payload)}}
        if unknown:
            reply["systemMessage"] = f"{unknown} unknown placeholder(s) were left in place"
        return json.dumps(reply, ensure_ascii=False)
    except Exception as e:  # fail closed
        return json.dumps({"hookSpecificOutput": {"hookEventName": "PreToolUse", "permissionDecision": "deny", "permissionDecisionReason": REFUSED}, "systemMessage": f"a tool call was refused: {type(e).__name__}"})
