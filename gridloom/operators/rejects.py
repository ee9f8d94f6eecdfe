"""Rows that fail to parse: separate bad lines, with reasons, from loadable ones.

The parser turns each raw line into cells (row, column, value); a rule table joined on the column says which
checks a cell must pass; failed checks are aggregated into reasons per row, and the clean rows are those left by an
anti-join against the failures.

Defined results for odd input
-----------------------------
* null line or unknown layout: rejected with ``line_is_null`` / ``unknown_layout``.
* empty or blank line: rejected (wrong number of columns, or malformed JSON).
* empty table: both outputs are empty.
* repeated lines, also with the same id or a null id: every input row is judged alone, also beside a bad row of its id;
  the rejects name each id once.
* extra columns are ignored, also those named like an output column.
* a very long line is parsed like any other, there is no length limit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.layout import cut

FIELDS = ("record_key", "image", "width", "height", "human", "gpt")
SEPARATORS = {"csv": ",", "tsv": "\t"}
#: column, rule: the checks that a cell of the column must pass.
RULES = (
    ("record_key", "digits"),
    ("image", "image_path"),
    ("width", "digits"),
    ("width", "positive"),
    ("height", "digits"),
    ("height", "positive"),
    ("human", "not_blank"),
    ("human", "no_replacement"),
    ("gpt", "no_replacement"),
    ("gpt", "answer"),
)
#: white space and invisible characters: a value of these alone is blank.
BLANKS = r"\s\p{Z}​-‏⁠﻿­\u0000"
PARSED = "_row long, layout_error string, cells array<struct<column:string,value:string>>"


class Malformed(ValueError):
    """A line that does not yield its cells; the message is the reason."""


def split_quoted(line: str, sep: str) -> list[str]:
    """The fields of one record under strict quoting rules.

    Raises Malformed for an open quote, text after a closing quote, a quote in an unquoted field, or a line break
    outside quotes. Unquoted values lose blanks around them.
    """
    out, at, end = [], 0, len(line)
    while True:
        if at < end and line[at] == '"':
            parts, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    raise Malformed("open_quote")
                parts.append(line[at:close])
                at = close + 1
                if at < end and line[at] == '"':
                    parts.append('"')
                    at += 1
                else:
                    break
            out.append("".join(parts))
            if at == end:
                return out
            if line[at] != sep:
                raise Malformed("text_after_quote")
            at += 1
        else:
            stop = line.find(sep, at)
            value = line[at:] if stop < 0 else line[at:stop]
            if '"' in value:
                raise Malformed("quote_in_unquoted")
            if "\n" in value or "\r" in value:
                raise Malformed("line_break_unquoted")
            out.append(value.strip(" \t 　"))
            if stop < 0:
                return out
            at = stop + 1


class _Number(str):
    """A JSON number as it was written."""


def _no_constant(name: str):
    raise Malformed("malformed_json")


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise Malformed("duplicate_key")
    return found


def parse_json_record(line: str) -> list[str]:
    """The six values of a strictly well-formed JSON record; numbers keep their spelling."""
    try:
        found = json.loads(line, object_pairs_hook=_pairs, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
    except Malformed:
        raise
    except (ValueError, RecursionError):
        raise Malformed("malformed_json") from None
    if not isinstance(found, dict):
        raise Malformed("not_an_object")
    if set(found) != {"record_key", "image", "width", "height", "conversations"}:
        raise Malformed("wrong_keys")
    turns = found["conversations"]
    if not isinstance(turns, list) or len(turns) != 2:
        raise Malformed("wrong_turns")
    for turn, role in zip(turns, ("human", "gpt")):
        if not isinstance(turn, dict) or set(turn) != {"from", "value"} or turn["from"] != role or isinstance(turn["from"], _Number):
            raise Malformed("wrong_turns")
        if not isinstance(turn["value"], str) or isinstance(turn["value"], _Number):
            raise Malformed("wrong_type")
    for key in ("record_key", "width", "height"):
        if not isinstance(found[key], str):
            raise Malformed("wrong_type")
    if not isinstance(found["image"], str) or isinstance(found["image"], _Number):
        raise Malformed("wrong_type")
    return [str(found[k]) for k in ("record_key", "image", "width", "height")] + [t["value"] for t in turns]


def parse_line(layout: str | None, line: str | None) -> tuple[str | None, list[str] | None]:
    """(reason, None) for a line that has no cells, else (None, the six values)."""
    if line is None:
        return "line_is_null", None
    line = line.removeprefix("﻿")
    line = line[:-1] if line.endswith("\n") else line
    line = line[:-1] if line.endswith("\r") else line
    try:
        if layout in SEPARATORS:
            cells = split_quoted(line, SEPARATORS[layout])
            if len(cells) != len(FIELDS):
                return "too_few_columns" if len(cells) < len(FIELDS) else "too_many_columns", None
        elif layout == "jsonl":
            cells = parse_json_record(line)
        else:
            return "unknown_layout", None
        for value in cells:
            value.encode()  # a lone surrogate is no text
        return None, cells
    except Malformed as why:
        return str(why), None
    except UnicodeEncodeError:
        return "malformed_text", None


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [parse_line(layout, line) for layout, line in zip(batch["layout"], batch["raw"])]
        yield pd.DataFrame(
            {
                "_row": batch["_row"],
                "layout_error": [why for why, _ in rows],
                "cells": [None if cells is None else [{"column": c, "value": v} for c, v in zip(FIELDS, cells)] for _, cells in rows],
            }
        )


def answer_ok(value: Column) -> Column:
    """Whether a gpt value is one or more groups of an optional label and boxes with ordered corners."""
    number = r"<(?:0*(?:[0-9]{1,3}|1000))>"
    box = rf"<box>(?:none|\s*{number}\s*{number}\s*(?:{number}\s*{number}\s*)?)</box>"
    group = rf"(?:<ref>[^<>]*[^<>{BLANKS}][^<>]*</ref>\s*)?(?:{box}\s*)++"
    four = r"<box>\s*<([0-9]+)>\s*<([0-9]+)>\s*<([0-9]+)>\s*<([0-9]+)>\s*</box>"
    corners = F.transform(F.array(*[F.regexp_extract_all(value, F.lit(four), F.lit(k)) for k in (1, 2, 3, 4)]), lambda a: F.transform(a, lambda x: x.try_cast("int")))
    ordered = F.forall(
        F.arrays_zip(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"), corners[3].alias("d")),
        lambda b: F.coalesce((b["a"] < b["c"]) & (b["b"] < b["d"]), F.lit(False)),
    )
    # Balanced groups are removed one kind after the other instead of matched by one nested pattern, as long answers
    # would overflow the stack of the matcher.
    bare = F.regexp_replace(F.regexp_replace(value, box, "\u0001"), rf"<ref>[^<>]*[^<>{BLANKS}][^<>]*</ref>", "\u0002")
    return ~value.contains("\u0001") & ~value.contains("\u0002") & F.regexp_replace(bare, r"\s+", "").rlike("^(?:\u0002?\u0001++)++$") & ordered


def rule_holds(rule: Column, value: Column) -> Column:
    """The outcome of a named rule for a cell value."""
    digits = value.rlike(r"\A[0-9]+\z")
    return (
        F.when(rule == "digits", digits)
        .when(rule == "positive", ~digits | value.rlike("[1-9]"))
        .when(rule == "image_path", value.rlike(r"(?is)(?:^|[/\\])[^/\\]*[^/\\\s.][^/\\]*\.(?:jpg|jpeg|png|webp)\z"))
        .when(rule == "not_blank", value.rlike(f"[^{BLANKS}]"))
        .when(rule == "no_replacement", ~value.contains("�"))
        .when(rule == "answer", answer_ok(value))
    )


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "column string, rule string")


def parse_cells(raw: DataFrame, row: str = "line_id") -> DataFrame:
    """One row per input line: its id, why it has no cells, and its cells."""
    lines = raw.select(F.col(row).alias("_row"), F.col("layout").cast("string").alias("layout"), F.col("raw").cast("string").alias("raw"))
    return lines.mapInPandas(_parse_batches, PARSED)


def cell_errors(parsed: DataFrame, by: str = "_row") -> DataFrame:
    """(by, reasons): every line that fails, with its sorted reasons."""
    rules = F.broadcast(rule_table(parsed.sparkSession))  # RULES is a fixed table of ten rows
    cells = parsed.select(by, F.posexplode_outer("cells").alias("_pos", "_cell"), "layout_error").select(by, "layout_error", F.col("_cell.column").alias("column"), F.col("_cell.value").alias("value"))
    judged = cells.join(rules, "column", "left").withColumn(
        "error",
        F.when(F.col("layout_error").isNotNull(), F.col("layout_error")).when(~F.coalesce(rule_holds(F.col("rule"), F.col("value")), F.lit(False)), F.concat("column", F.lit("."), "rule")),
    )
    return judged.filter("error is not null").groupBy(by).agg(F.array_sort(F.collect_set("error")).alias("reasons"))


def split_rejects(raw: DataFrame, row: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """(clean records, rejects).

    Clean: the row id and the six typed values. Rejects: the row id and the reasons. Every line is parsed once, into a
    table of the shared folder, in which it has a number of its own.
    """
    parsed = cut(parse_cells(raw, row).withColumn("_line", F.monotonically_increasing_id()))
    value = lambda k: F.element_at(F.col("cells"), k + 1)["value"]
    typed = parsed.join(cell_errors(parsed, "_line"), "_line", "left_anti").select(
        F.col("_row").alias(row),
        value(0).alias("record_key"),
        value(1).alias("image"),
        value(2).cast("decimal(38,0)").alias("width"),
        value(3).cast("decimal(38,0)").alias("height"),
        value(4).alias("human"),
        value(5).alias("gpt"),
    )
    return typed, cell_errors(parsed).select(F.col("_row").alias(row), "reasons")
