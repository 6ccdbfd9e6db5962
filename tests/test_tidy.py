"""Planted messy grids, chats and columns."""
import datetime as dt

from pyspark.sql import functions as F

from gridloom.functions import dates as D
from gridloom.operators import grid as G
from gridloom.operators import tidy as T
from gridloom.sources import files as S
from gridloom.sources import records as R


def grid(spark, rows, file="f"):
    return spark.createDataFrame([(file, "csv", i, [str(c) for c in r]) for i, r in enumerate(rows)], "file string, sheet string, row_no long, cells array<string>")


STACKED = [["Baseline", "", "", ""], ["Name", "Age", "Run sec", "City"], ["Asha", "9", "12.5", "Pune"], ["Ravi", "10", "11.0", "Satara"], ["Total", "", "2", ""], ["", "", "", ""],
           ["Endline", "", "", ""], ["Name", "Age", "Run sec", "City"], ["Asha", "10", "11.5", "Pune"], ["Meena", "8", "13.0", "Pune"], ["Source: survey", "", "", ""]]


def test_stacked_blocks_become_one_table(spark):
    cells = G.tidy_cells(grid(spark, STACKED)).cache()
    assert cells.select("table_id").distinct().count() == 1
    wide = G.stack_table(cells, cells.first().table_id, ["Name", "Age", "Run sec", "City"]).orderBy("row_no").collect()
    assert [(r.block, r.Name, r["Run sec"]) for r in wide] == [("Baseline", "Asha", "12.5"), ("Baseline", "Ravi", "11.0"), ("Endline", "Asha", "11.5"), ("Endline", "Meena", "13.0")]


def test_two_row_header_and_repeats(spark):
    rows = [["", "Sports", "", "", "", ""], ["Name", "", "Score", "Score", "", "City"], ["Asha", "5", "1", "2", "x", "Pune"], ["Ravi", "6", "1", "2", "y", "Pune"]]
    names = [r["column"] for r in G.tidy_cells(grid(spark, rows)).select("pos", "column").distinct().orderBy("pos").collect()]
    assert names == ["Name", "Sports", "Score", "Score (2)", "col_5", "City"]


def test_csv_scan_keeps_places_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('x,"a, ""b""",\n\n"two\nlines",1,2\nlast,caf\xe9,3\n'.encode("latin-1"))
    got = {r.row_no: r.cells for r in S.read_grid(spark, str(tmp_path)).collect()}
    assert got == {0: ["x", 'a, "b"', ""], 1: [""], 2: ["two\nlines", "1", "2"], 3: ["last", "caf�", "3"]}


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = S.read_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1
        assert got.filter(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("line")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_chat(spark):
    text = ["12/03/24, 9:15 am - Messages are encrypted", "12/03/24, 9:16 am - Asha: planted 25 trees", "and more", "", "13/03/24, 9:17 am - Ravi: <Media omitted>",
            "13/03/24, 9:18 am - Ravi left", "stray", "14/03/24, 10:00 - Asha: ok", "14/03/24, 10:01 - Asha: 7", "14/03/24, 10:02 - Ravi: call 98765"]
    lines = spark.createDataFrame([("c", i, x) for i, x in enumerate(text)], "file string, line_no long, line string")
    got = [(r.sender, r.message, r.first_number, r.media, r.date) for r in R.parse_chat(lines).orderBy("line_no").collect()]
    assert got[0] == ("Asha", "planted 25 trees\nand more", 25, False, dt.date(2024, 3, 12)) and got[1][3] is True and len(got) == 5
    assert R.parse_chat(lines.filter("line_no < 5")).count() == 0


def test_layout_rows(spark):
    rows = [("Ward A", "", "", ""), ("Name", "Age", "Sex", "City"), ("Asha", "9", "F", "Pune"), ("Ravi", "8", "M", "Pune"), ("Total", "", "2", "")]
    got = [r.layout for r in T.layout_rows(spark.createDataFrame(rows, "Name string, Age string, Sex string, City string"), ["Name", "Age", "Sex", "City"]).collect()]
    assert got == ["subheading", "repeated_header", None, None, "total"]


def test_numbers_ids_and_gps(spark):
    rows = [(f"1,{i:03d}", f"98765432{i:02d}", "ABCDE1234F", "18.5204, 73.8567") for i in range(20)]
    df = spark.createDataFrame(rows, "a string, phone string, pan string, place string")
    _out, hit = T.coerce_numbers(df)
    assert hit == ["a"]
    out, cols = T.split_gps(df)
    assert cols == ["place"] and out.first()["place long"] == 73.8567


def test_dates(spark):
    df = spark.createDataFrame([("03/04/2024", "13/04/2024 10:30", "04/13/2024")] * 5 + [("7/4/24", "1/4/2024 00:00", "12/31/2024")], "a string, b string, c string")
    out, done = T.coerce_dates(df)
    assert done == {"a": "day first", "b": "day first", "c": "month first"}
    assert [f.dataType.simpleString() for f in out.schema] == ["date", "timestamp_ntz", "date"]
    assert out.first().a == dt.date(2024, 4, 3)
    one = spark.range(1).select(D.parse_date(F.lit("31/02/2024")).alias("x"), D.parse_date(F.lit("5 Mar 2024")).alias("y"), D.edge(F.lit("Feb 2024"), True).alias("z")).first()
    assert (one.x, one.y, one.z) == (None, dt.date(2024, 3, 5), dt.date(2024, 2, 29))


def test_variants_take_the_most_frequent_spelling(spark):
    df = spark.createDataFrame([("Soyabean",)] * 3 + [("SOYABEAN ",), ("soyabean",), ("Wheat",)], "c string")
    out, cols = T.canonicalise(df)
    assert cols == ["c"] and {r.c for r in out.collect()} == {"Soyabean", "Wheat"}


def test_pages_keep_paragraphs(spark):
    text = "\n".join(["a" * 100] * 50)
    got = [r.text for r in R.to_pages(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", 1000).orderBy("page").collect()]
    assert "".join(got).rstrip("\n") == text and max(map(len, got)) <= 1101


def test_folder_paths_stop_at_the_cap(spark):
    rows = [(f"d{i}", f"d{i - 1}" if i else None, f"n{i}", False) for i in range(20)]
    got = {r.id: r.path for r in S.resolve_paths(spark.createDataFrame(rows, "id string, parent_id string, name string, shared boolean")).collect()}
    assert got["d3"] == "n0/n1/n2" and got["d0"] == ""
    assert got["d19"].split("/") == [f"n{i}" for i in range(6, 19)]


def test_fold_regions_refuses_conflicts(spark):
    ok = [("a", "x", 2001, "m", 1.0), ("b", "x", 2001, "m", 2.0)]
    df = spark.createDataFrame(ok, "region string, category string, year int, metric string, value double")
    assert {r.metric for r in R.fold_regions(df, {"a": "north", "b": "south"}).collect()} == {"north m", "south m"}
    bad = df.union(spark.createDataFrame([("a", "x", 2001, "m", 9.0)], df.schema))
    try:
        R.fold_regions(bad, {"a": "north", "b": "south"}).collect()
        raise AssertionError("conflict not found")
    except Exception as e:  # noqa: BLE001
        assert "conflicting values" in str(e)


def test_the_tasks_of_a_grid_follow_its_rows(spark, monkeypatch):
    grid = spark.range(2000).select((F.col("id") % 3).cast("string").alias("file"), F.lit("s").alias("sheet"), F.floor(F.col("id") / 3).alias("row_no"), F.when(
        F.col("id") < 3, F.array(F.lit("Name"), F.lit("Mark"))).otherwise(F.array(F.concat(F.lit("n"), F.col("id").cast("string")), F.col("id").cast("string"))).alias("cells"))
    few = sorted(map(str, G.split_blocks(grid).select("file", "row_no", "block", "names").collect()))
    monkeypatch.setattr(G, "ROWS_PER_TASK", 50)
    many = G.split_blocks(grid)
    dealt = [line for line in many._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert G.tasks_for(grid) == 41 and len(dealt) >= 3 and all("], 41" in line for line in dealt)
    assert len(few) == 2000 and sorted(map(str, many.select("file", "row_no", "block", "names").collect())) == few
