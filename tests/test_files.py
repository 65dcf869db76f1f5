"""Zip archives of CSV files as a data source; CSV rows numbered in file order over many splits."""

import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.sources import read_csv_in_order, read_zipped_csv, write_zipped_csv
from cohortlens.sources import zipped

SF = "/root/testdata/sf0.001"


def archive(path, members, **options):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, **options) as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_members_types_and_missing_values(spark, tmp_path):
    archive(tmp_path / "a.zip", {
        "events.csv": "user_id,event_dt,name,amount\n1,2024-01-01 10:00:00,login,1.5\nbad,2024-13-02 00:00:00,\"x, y\",NA\n",
        "deep/": "", "deep/more.csv": "name,user_id\n\"two\nlines\",7\n\"a \"\"q\"\"\",\n", "empty.csv": "", "head.csv": "user_id,name\n"})
    archive(tmp_path / "b.zip", {"x.csv": "amount,user_id,other\n2.5,9,z\n"})
    archive(tmp_path / "none.zip", {})
    (tmp_path / "readme.txt").write_text("not an archive")
    df = read_zipped_csv(spark, str(tmp_path), "user_id long, event_dt timestamp_ntz, name string, amount double")
    rows = {(r.user_id, str(r.event_dt) if r.event_dt else None, r.name, r.amount) for r in df.collect()}
    assert rows == {(1, "2024-01-01 10:00:00", "login", 1.5), (None, None, "x, y", None), (7, None, "two\nlines", None),
                    (None, None, 'a "q"', None), (9, None, None, 2.5)}
    # one partition a member, whichever archive it is in
    assert df.rdd.getNumPartitions() == 5
    only_b = read_zipped_csv(spark, str(tmp_path / "b*.zip"), "user_id int, amount string")
    assert [tuple(r) for r in only_b.collect()] == [(9, "2.5")]
    assert read_zipped_csv(spark, str(tmp_path / "a.zip"), "user_id int").count() == 4


def test_formats_of_dates(spark, tmp_path):
    archive(tmp_path / "a.zip", {"a.csv": "d;t\n03.02.2024;03.02.2024 04:05\n2024-02-03;x\n"})
    df = read_zipped_csv(spark, f"file://{tmp_path}/a.zip", "d date, t timestamp_ntz", sep=";", date_format="dd.MM.yyyy",
                         timestamp_format="dd.MM.yyyy HH:mm")
    assert [(str(r.d), str(r.t)) for r in df.collect()] == [("2024-02-03", "2024-02-03 04:05:00"), ("None", "None")]


def test_round_trip_and_modes(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    path = str(tmp_path / "out")
    write_zipped_csv(events.repartition(3), path)
    assert len(zipped.listing(path)) == 3
    back = read_zipped_csv(spark, path, events.schema)
    assert back.exceptAll(events).count() == 0 and events.exceptAll(back).count() == 0
    write_zipped_csv(events.limit(5), path)
    assert read_zipped_csv(spark, path, events.schema).count() == events.count() + 5
    write_zipped_csv(events.limit(5).coalesce(1), path, mode="overwrite")
    assert read_zipped_csv(spark, path, events.schema).count() == 5 and len(zipped.listing(path)) == 1
    write_zipped_csv(events.limit(0), str(tmp_path / "no"))
    assert zipped.listing(str(tmp_path / "no")) == [] and read_zipped_csv(spark, str(tmp_path / "no"), events.schema).count() == 0


def test_a_failed_task_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "failed")
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception):
        write_zipped_csv(bad, path)
    assert zipped.listing(path) == []


def test_memory_of_a_large_member(tmp_path):
    """Half a gigabyte of text in one zip64 member passes in blocks."""
    line = b"".join(b"%09d,some words of a row,%d\n" % (i, i % 7) for i in range(20_000))
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        with z.open("big.csv", "w", force_zip64=True) as f:
            f.write(b"a,b,c\n")
            for _ in range(800):
                f.write(line)
    member, = zipped.members(str(tmp_path / "big.zip"))
    reader = zipped.ZippedCsvReader(["a", "c"], str(tmp_path / "big.zip"), ",")
    before, most, rows = pa.total_allocated_bytes(), 0, 0
    for batch in reader.read(member):
        rows += batch.num_rows
        most = max(most, pa.total_allocated_bytes() - before)
    assert rows == 16_000_000 and most < 12 * zipped.BLOCK_BYTES


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_file_order_over_many_splits(spark, tmp_path, small_splits):
    want, k = [], 0
    for name in ("b.csv", "a.csv", "c.csv"):
        with open(tmp_path / name, "w") as f:
            f.write("x,y\n")
            for i in range(1500 if name != "c.csv" else 0):
                f.write(f"{name}{i},{i if i % 10 else 'bad'}\n" + ("\n" if i % 400 == 7 else ""))
    for name in ("a.csv", "b.csv"):
        for i in range(1500):
            want.append((k, f"{name}{i}", i if i % 10 else None))
            k += 1
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = read_csv_in_order(spark, str(tmp_path), "x string, y int")
    assert got.columns == ["row_idx", "x", "y"]
    assert sorted(tuple(r) for r in got.collect()) == want
    bare = read_csv_in_order(spark, str(tmp_path / "a.csv"), "x string, y int", header=False, index_col="n")
    assert bare.orderBy("n").first() == (0, "x", None) and bare.count() == 1501


def test_no_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_csv_in_order(spark, str(tmp_path), "x int").count() == 0
    (tmp_path / "a.csv").write_text("x\n")
    assert read_csv_in_order(spark, str(tmp_path), "x int").count() == 0
