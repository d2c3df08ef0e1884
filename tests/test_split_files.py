"""Multi-line CSV and JSON arrays read by several tasks a file, with the rows of Spark's own whole-file reader."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from themelens.sources import io
from themelens.sources.split_files import _then, json_effect

COLUMNS = ["titulo", "autor", "resumo"]
SCHEMA = "titulo string, autor string, resumo string"


def values(r, n):
    bits = ["plain", "two\nlines", 'a "quoted" word', "comma, here", "{brace}", "[x]", "}{", "\\", '\\"', "é漢𐍈", "", "\r\nwin", "'", "\n\n", "]}"]
    return [[str(k), *["".join(r.choice(bits) for _ in range(r.randrange(6))) for _ in COLUMNS[1:]]] for k in range(n)]


def small_splits(spark, monkeypatch, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def undo():
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    return undo


def read_both(spark, path, size, monkeypatch, schema):
    whole = sorted(map(repr, io.read_records(spark, path, schema=schema, splittable=False).collect()))
    undo = small_splits(spark, monkeypatch, size)
    try:
        return whole, sorted(map(repr, io.read_records(spark, path, schema=schema).collect()))
    finally:
        undo()


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


@pytest.mark.parametrize("size", [60, 1000, 1 << 20])
def test_csv(spark, tmp_path, monkeypatch, schema, size):
    rows = values(random.Random(1), 25 if size < 64 else 200)
    path = tmp_path / "r.csv"
    for end in ("\n", "\r\n"):
        with open(path, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(COLUMNS)
            out.writerows(rows)
        whole, split = read_both(spark, str(path), size, monkeypatch, schema)
        assert split == whole and len(split) == len(rows)


@pytest.mark.parametrize("size", [70, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_array(spark, tmp_path, monkeypatch, schema, size, indent):
    rows = [dict(zip(COLUMNS, v)) | {"other": {"deep": [{"x": "}]{"}, []]}} for v in values(random.Random(2), 20 if size < 100 else 200)]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    whole, split = read_both(spark, str(path), size, monkeypatch, schema)
    assert split == whole and len(split) == len(rows)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch, schema):
    """Of one file of each kind, the parse of the records runs in more than one task."""
    rows = values(random.Random(3), 3000)
    table, array = tmp_path / "r.csv", tmp_path / "r.json"
    with open(table, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([COLUMNS, *rows])
    array.write_text(json.dumps([dict(zip(COLUMNS, v)) for v in rows]), encoding="utf-8")
    undo = small_splits(spark, monkeypatch, 30_000)
    try:
        for path in (table, array):
            read = io.read_records(spark, str(path), schema=schema)
            assert read.select(F.spark_partition_id()).distinct().count() > 3
            assert read.count() == len(rows)
    finally:
        undo()


def test_several_files_and_odd_ones(spark, tmp_path, monkeypatch, schema):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in range(3):
        with open(folder / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([COLUMNS, *values(random.Random(k), 30)])
    whole, split = read_both(spark, str(folder), 300, monkeypatch, schema)
    assert split == whole and len(split) == 90
    for text, n in (("[]", 0), ("[ ]\n", 0), ('﻿[{"titulo": "A"}]', 1), ('[\n{"titulo": "A"}\n,\n\n{"autor": "]"}\n]\n', 2)):
        path = tmp_path / "odd.json"
        path.write_text(text, encoding="utf-8")
        assert io.read_records(spark, str(path), schema=schema).count() == n
    for text in ('[{"titulo": "A"}', '[{"titulo": "A"}, {"titulo": "B', '[{"titulo": "A"} x {"titulo": "B"}]'):
        path.write_text(text)
        with pytest.raises(Exception):
            io.read_records(spark, str(path), schema=schema).collect()
    header = tmp_path / "header.csv"
    header.write_text("titulo,autor\n")
    assert io.read_records(spark, str(header)).count() == 0
    unclosed = tmp_path / "unclosed.csv"
    unclosed.write_text('titulo,autor\na,b"c\nd,e\n')
    with pytest.raises(Exception):
        io.read_records(spark, str(unclosed)).collect()


def test_effects_compose():
    text = '[{"a": "x}\\"[", "b\\\\": [1, {"c": "{"}]}, {"d": []}]'
    for cut in range(1, len(text)):
        if text[cut - 1] == "}":
            assert _then(json_effect(text[:cut]), json_effect(text[cut:]))[:2] == json_effect(text)[:2] == (0, 0)
