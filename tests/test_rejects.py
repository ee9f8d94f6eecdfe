import json

import pytest

from gridloom.operators.rejects import cell_errors, parse_cells, parse_line, split_rejects

GOOD = '7,shots/a/b_1.jpg,720,1600,Where?,<ref>icon</ref><box><1><2><3><4></box>'
RECORD = {"record_key": 7, "image": "a/b.webp", "width": "720", "height": 1600, "conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "<box>none</box>"}]}

CASES = [
    ("csv", GOOD, ()),
    ("csv", "﻿" + GOOD + "\r", ()),
    ("csv", GOOD.replace(",720,", ", 720 ,"), ()),
    ("csv", '"7","a,b.PNG","720","1600","say ""x""\nnow","<box>none</box>"', ()),
    ("tsv", GOOD.replace(",", "\t"), ()),
    ("csv", GOOD + ",", ("too_many_columns",)),
    ("csv", GOOD.replace(",720", ""), ("too_few_columns",)),
    ("csv", GOOD.replace("Where?", '"Where?'), ("open_quote",)),
    ("csv", GOOD.replace("Where?", '"Where?" x'), ("text_after_quote",)),
    ("csv", GOOD.replace("Where?", 'Wh"ere?'), ("quote_in_unquoted",)),
    ("csv", GOOD.replace("Where?", "Wh\nere?"), ("line_break_unquoted",)),
    ("csv", GOOD.replace("720", "７２０"), ("width.digits",)),
    ("csv", GOOD.replace("720", "0"), ("width.positive",)),
    ("csv", GOOD.replace("b_1.jpg", ".jpg"), ("image.image_path",)),
    ("csv", GOOD.replace("Where?", " "), ("human.not_blank",)),
    ("csv", GOOD.replace("Where?", "W�"), ("human.no_replacement",)),
    ("csv", GOOD.replace("<3>", "<1>"), ("gpt.answer",)),
    ("csv", GOOD.replace("<3>", "<1001>"), ("gpt.answer",)),
    ("csv", GOOD.replace("icon", " "), ("gpt.answer",)),
    ("csv", GOOD.replace("<ref>", " <ref>").replace("<box>", " <box> "), ()),
    ("csv", GOOD + "<ref>icon</ref>", ("gpt.answer",)),
    ("jsonl", json.dumps(RECORD), ()),
    ("jsonl", json.dumps(RECORD) + "}", ("malformed_json",)),
    ("jsonl", json.dumps(RECORD).replace('"width"', '"image"'), ("duplicate_key",)),
    ("jsonl", json.dumps(RECORD | {"more": 1}), ("wrong_keys",)),
    ("jsonl", json.dumps(RECORD | {"record_key": None}), ("wrong_type",)),
    ("jsonl", json.dumps(RECORD | {"record_key": 7.5}), ("record_key.digits",)),
    ("jsonl", json.dumps(RECORD | {"conversations": RECORD["conversations"][::-1]}), ("wrong_turns",)),
    ("jsonl", '{"record_key": NaN}', ("malformed_json",)),
    ("jsonl", "", ("malformed_json",)),
    ("jsonl", None, ("line_is_null",)),
    ("xml", GOOD, ("unknown_layout",)),
    (None, GOOD, ("unknown_layout",)),
]


def lines(spark, rows):
    return spark.createDataFrame(rows, "line_id long, layout string, raw string, reasons string")


def test_reasons(spark):
    df = lines(spark, [(i, layout, raw, "kept") for i, (layout, raw, _) in enumerate(CASES)])
    found = {r._row: tuple(r.reasons) for r in cell_errors(parse_cells(df)).collect()}
    assert found == {i: why for i, (_, _, why) in enumerate(CASES) if why}
    clean, rejects = split_rejects(df)
    assert sorted(r.line_id for r in clean.collect()) == [i for i, c in enumerate(CASES) if not c[2]]
    assert rejects.count() == sum(bool(c[2]) for c in CASES)


def test_repeated_lines_and_empty_table(spark):
    df = lines(spark, [(1, "csv", GOOD, None)] * 2 + [(2, "csv", "", None)] * 2)
    clean, rejects = split_rejects(df)
    assert clean.count() == 2 and [r.line_id for r in rejects.collect()] == [2]
    clean, rejects = split_rejects(df.filter("false"))
    assert clean.count() == rejects.count() == 0


def test_good_and_bad_lines_of_one_id_or_none(spark):
    df = lines(spark, [(1, "csv", GOOD, None), (1, "csv", "", None), (1, "xml", GOOD, None), (None, "csv", GOOD, None), (None, "csv", None, None), (None, None, GOOD, None), (2, "csv", "", None)])
    clean, rejects = split_rejects(df)
    assert sorted((r.line_id or 0, r.record_key) for r in clean.collect()) == [(0, "7"), (1, "7")]
    assert {r.line_id: len(r.reasons) for r in rejects.collect()} == {None: 2, 1: 2, 2: 1}


def test_very_long_answer(spark):
    answer = "<ref>icon</ref>" + "<box><1><2><3><4></box>" * 20000
    df = lines(spark, [(1, "csv", f"7,a/b.png,1,1,x,{answer}", None), (2, "csv", f"7,a/b.png,1,1,x,{answer}<box>", None)])
    assert [r._row for r in cell_errors(parse_cells(df)).collect()] == [2]


@pytest.mark.parametrize("text", ['"a""b"', '"', '""', "a", '","'])
def test_quoting_round_trip(text):
    quoted = '"' + text.replace('"', '""') + '"'
    assert parse_line("csv", ",".join([quoted] * 6)) == (None, [text] * 6)
