"""Native scans: quoting, blank records, locators, header and encoding gates, typed cells."""

from __future__ import annotations

import random
import csv
import hashlib
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from crashmart.contracts import FileSpec
from crashmart.errors import ContractError
from crashmart.sources import delimited as D, inventory, records, sinks
from crashmart.sources.native_text import native_text

SPEC = FileSpec("r", "s", "crash", ("id", "name", "No. x"), ("id",), "sha")
WIDE = FileSpec("r", "s", "crash", ("id", "name", "No. x"), ("id",), "sha", multi_line=True)


def write(tmp_path, text, name="a.csv"):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode("utf-8"))
    return str(path)


def test_values_stay_text_and_blank_records_keep_their_number(spark, tmp_path):
    path = write(tmp_path, '﻿id,name,No. x\r\n0001,"a ""b"", c",\r\n\r\n 02 ,,"007"\n')
    D.check_headers(spark, path, SPEC)
    rows = D.scan(spark, path, SPEC).orderBy("position").collect()
    assert [(r["position"], r["id"], r["name"], r["No. x"]) for r in rows] == [(1, "0001", 'a "b", c', ""), (3, " 02 ", "", "007")]


def test_same_rows_as_the_standard_reader(spark, tmp_path):
    rows = [(str(i), ["plain", 'q"uote', "co,mma", "", " pad "][i % 5], str(i * 7)) for i in range(2000)]
    path = tmp_path / "b.csv"
    with path.open("w", newline="") as out:
        w = csv.writer(out)
        w.writerow(SPEC.header)
        w.writerows(rows)
    got = D.scan(spark, str(path), SPEC).orderBy("position").collect()
    with path.open(newline="") as back:
        want = list(csv.reader(back))[1:]
    assert [[r["id"], r["name"], r["No. x"]] for r in got] == want
    assert [r["position"] for r in got] == list(range(1, 2001))


def test_positions_survive_many_splits(spark, tmp_path):
    path = write(tmp_path, "id,name,No. x\n" + "".join(f"{i},{'y' * (i % 90)},z\n" for i in range(1, 6001)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        df = D.scan(spark, path, SPEC)
        assert df.select(F.spark_partition_id()).distinct().count() > 4
        assert df.filter(F.col("position") != F.col("id").cast("bigint")).count() == 0
        assert df.count() == 6000
    finally:
        spark.conf.set(key, before)


def test_line_breaks_inside_fields(spark, tmp_path):
    path = write(tmp_path, 'id,name,No. x\n1,"two\nlines",x\n2,b,y\n')
    D.check_headers(spark, path, WIDE)
    got = D.scan(spark, path, WIDE).orderBy("position").collect()
    assert [(r["position"], r["name"]) for r in got] == [(1, "two\nlines"), (2, "b")]


@pytest.mark.parametrize("head, code", [("id,id,No. x", "DUPLICATE_HEADER"), ("name,id,No. x", "HEADER_MISMATCH"), ("id,name", "HEADER_MISMATCH")])
def test_header_contract(spark, tmp_path, head, code):
    with pytest.raises(ContractError) as e:
        D.check_headers(spark, write(tmp_path, head + "\n1,2,3\n"), SPEC)
    assert e.value.code == code


def test_gates(spark, tmp_path):
    path = write(tmp_path, b"id,name,No. x\n1,a,b\n2,a\n3,a,b,c\n4,\x00,b\n5,\xff,b\n")
    rows = D.scan(spark, path, SPEC)
    g = D.gate_counts(rows, SPEC).first()
    assert (g["raw_count"], g["row_width_mismatch"], g["nul_character"], g["invalid_utf8"]) == (5, 2, 1, 1)
    assert {r["row_locator"] for r in D.malformed(rows).collect()} == {"csv:2", "csv:3"}


def test_trailing_blank_rows(spark):
    df = spark.createDataFrame([("f", 1, "a"), ("f", 2, None), ("f", 3, "b"), ("f", 4, None), ("f", 5, None)], "file string, position int, a string")
    assert [r["position"] for r in D.trim_trailing_blank(df, ["a"]).orderBy("position").collect()] == [1, 2, 3]


def test_records_round_trip(spark, tmp_path):
    path = write(tmp_path, "id,name,No. x\n1,é,\n2,b,c\n")
    rec = D.to_records(D.scan(spark, path, SPEC), SPEC)
    out = str(tmp_path / "records")
    records.write_records(rec, out)
    back = records.read_records(spark, out)
    key = lambda df: sorted((r["raw_record_id"], r["row_locator"], tuple(sorted(r["payload"].items()))) for r in df.collect())
    assert key(back) == key(rec)
    assert records.payload_shape_errors(back, list(SPEC.header)).count() == 0
    assert records.payload_shape_errors(back, ["id", "name"]).count() == 2
    files = spark.createDataFrame([("s", "r", "sha", "csv-native-v1", 2)], "source_id string, resource_id string, file_sha256 string, parser_version string, raw_count bigint")
    row = records.record_checks(back.unionByName(back.limit(1)), files).first()
    assert (row["row_count"], row["repeated_position_count"], row["count_match"]) == (3, 1, False)


def test_records_are_compressed_and_dealt_to_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "JSON_ROWS", 40)
    path = write(tmp_path, "id,name,No. x\n" + "".join(f"{i},name of {i},{i * 7}\n" for i in range(100)))
    rec = D.to_records(D.scan(spark, path, SPEC), SPEC).coalesce(1)
    out = tmp_path / "records"
    records.write_records(rec, str(out))
    assert len(list(out.rglob("*.json.gz"))) == 3 and not list(out.rglob("*.json"))
    assert sorted(r["row_locator"] for r in records.read_records(spark, str(out)).collect()) == sorted(f"csv:{i + 1}" for i in range(100))


def test_typed_cells(spark):
    df = spark.createDataFrame([(date(2020, 1, 2), datetime(2020, 1, 2, 3, 4, 5), 1e7, 0.0001, Decimal("1.50"), None),
                                (date(2020, 1, 2), datetime(2020, 1, 2, 3, 4, 5, 60), 5.0, -2.5e-7, Decimal("0.00"), "x")],
                               "d date, t timestamp, a double, b double, c decimal(5,2), s string")
    a, b = native_text(df).collect()
    assert tuple(a) == ("2020-01-02", "2020-01-02T03:04:05", "10000000.0", "0.0001", "1.50", None)
    assert tuple(b) == ("2020-01-02", "2020-01-02T03:04:05.000060", "5.0", "-0.00000025", "0.00", "x")
    with pytest.raises(ContractError):
        native_text(spark.createDataFrame([(True,)], "x boolean"))
    with pytest.raises(Exception, match="INVALID_NUMBER"):
        native_text(spark.createDataFrame([(float("nan"),)], "x double")).collect()


def test_inventory_hashes(spark, tmp_path):
    write(tmp_path, "hello", "one.csv")
    write(tmp_path, "world!", "two.csv")
    got = {r["path"].rsplit("/", 1)[1]: r for r in inventory.inventory(spark, str(tmp_path) + "/*.csv").collect()}
    assert got["one.csv"]["file_sha256"] == hashlib.sha256(b"hello").hexdigest() and got["two.csv"]["byte_size"] == 6
    found = inventory.inventory(spark, str(tmp_path) + "/*.csv")
    pinned = found.withColumn("file_sha256", F.when(F.col("path").endswith("two.csv"), "0").otherwise(F.col("file_sha256")))
    assert sorted(r["hash_match"] for r in inventory.compare_with_pinned(found, pinned).collect()) == [False, True]


def test_inventory_lists_in_tasks(spark, tmp_path):
    for name in ("a b/one.csv", "a b/.hidden.csv", "a b/_part.csv", "c/two.csv", "c/three.txt", "c/deep.csv/four.x", "c/deep.csv/_log/five.x", "d/k=1/six.x", "d/k=2/_no.x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    names = lambda path: sorted(r["path"].removeprefix(f"file:{tmp_path}/") for r in inventory.inventory(spark, path).collect())
    spark_names = lambda path: sorted(r["path"].removeprefix(f"file:{tmp_path}/") for r in spark.read.format("binaryFile").load(path).select("path").collect())
    for path in ("*/*.csv", "*/*", "c", "c/two.csv", "c/t*", "[ab]*/on?.csv", "{c/two,c/three}.*", "d"):
        assert names(f"{tmp_path}/{path}") == spark_names(f"{tmp_path}/{path}"), path
    assert names(f"{tmp_path}/*/*.none") == []
    with pytest.raises(ContractError, match="NO_FILES"):
        inventory.inventory(spark, f"{tmp_path}/none/*.csv")


def test_documents_are_files_in_few_folders(spark, tmp_path, monkeypatch):
    from catalog import storage
    texts = {i: f"text {i}\nline two é" for i in range(300)}
    rows = [(i, text) for i, text in texts.items()] + [(None, "x"), (999, None), (7, "again")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(storage, "scratch_path", lambda spark, name: str(tmp_path / "scratch" / name))
    got = {r["doc_id"]: (r["byte_size"], r["file_sha256"]) for r in storage.file_inventory(spark, str(tmp_path)).collect()}
    content = {i: f"{text}\n".encode() for i, text in texts.items()}
    content[7] += b"again\n"
    assert got == {i: (len(x), hashlib.sha256(x).hexdigest()) for i, x in content.items()}
    # A folder for each document cost the file system several calls each, and the driver a rename.
    assert len(list((tmp_path / "scratch").glob("files/*"))) < 20 and len(list((tmp_path / "scratch").rglob("doc_id=*"))) == 300


def test_evidence_count_must_match(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    sinks.write_differences(df, str(tmp_path / "ok"), 2)
    with pytest.raises(ContractError):
        sinks.write_differences(df, str(tmp_path / "bad"), 3)


def test_doubles_keep_every_digit(spark):
    """The text of a double without an exponent reads back as the same double."""
    rng = random.Random(1)
    values = [1e-20, 1.23e-19, 1.2345678901234568e-05, 1e21, 1e25, 1e16, 1.5e16, 123456789.125, 1e7, -2.5e-300, 1.7976931348623157e308, 5e-324, 0.0, -0.0, 100.0]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(300)]
    got = [r["x"] for r in native_text(spark.createDataFrame([(v,) for v in values], "x double")).collect()]
    assert [v for g, v in zip(got, values, strict=True) if "E" in g or float(g) != v] == []
    assert got[:6] == ["0.00000000000000000001", "0.000000000000000000123", "0.000012345678901234568", "1" + "0" * 21, "1" + "0" * 25, "1" + "0" * 16]
    assert got[7:9] == ["123456789.125", "10000000.0"]


def test_records_over_lines_and_splits_keep_their_numbers(spark, tmp_path):
    """Blank records count, quoted line breaks don't, wherever a split ends."""
    text, want = "id,name,No. x\n", []
    rng, number = random.Random(3), 0
    for i in range(300):
        number += 1
        if rng.random() < 0.2:
            text += "\n"
            continue
        name = "".join(rng.choice(["a", "\n", '"', ",", "\n\n", "long " * 3]) for _ in range(rng.randint(1, 6)))
        text += f'{i},"{name.replace(chr(34), chr(34) * 2)}",x\n'
        want.append((number, str(i), name, "x"))
    path, before = write(tmp_path, text), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "512b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = D.scan(spark, path, WIDE).orderBy("position").collect()
            assert [(r["position"], r["id"], r["name"], r["No. x"]) for r in rows] == want
            assert not any(r["_malformed"] for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
