import pytest
from pyspark.sql import functions as F

from blotter import operators as op
from blotter import sources
from blotter.schema import INCIDENT_RAW, INCIDENT_TYPED, RAW_COLUMNS

ROW = {
    "ID": "7",
    "Case Number": "HX1",
    "Date": "01/01/2020 12:00:00 AM",
    "IUCR": "0110",
    "Primary Type": "THEFT",
    "Location Description": "STREET, CORNER",
    "Arrest": "true",
    "Domestic": "false",
    "Ward": "7.0",
    "Community Area": "08",
    "Latitude": "41.8",
    "Longitude": "-87.6",
    "Location": "(41.8, -87.6)",
}


def incident(**changes):
    return tuple({**ROW, **changes}.get(c) for c in RAW_COLUMNS)


def test_schemas_have_the_same_columns():
    assert len(RAW_COLUMNS) == 22
    assert [c.replace(" ", "_") for c in INCIDENT_RAW.names] == INCIDENT_TYPED.names


def test_csv_roundtrip_by_name(spark, tmp_path):
    raw = spark.createDataFrame([incident(), incident(ID="8", Location=None)], INCIDENT_RAW)
    shuffled = raw.select(*[F.col(f"`{c}`") for c in reversed(RAW_COLUMNS)])
    sources.write_csv(shuffled, str(tmp_path / "csv"))
    back = sources.read_incidents_csv(spark, str(tmp_path / "csv"))
    assert back.schema == INCIDENT_RAW
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in raw.collect()}


def test_csv_reports_missing_columns(spark, tmp_path):
    sources.write_csv(spark.range(3).select(F.col("id").alias("ID")), str(tmp_path / "csv"))
    with pytest.raises(ValueError, match="Case Number"):
        sources.read_incidents_csv(spark, str(tmp_path / "csv"))


def test_csv_types_on_request(spark, tmp_path):
    sources.write_csv(spark.range(3).select(F.col("id").alias("ID")), str(tmp_path / "csv"))
    read = sources.read_incidents_csv(spark, str(tmp_path / "csv"), ["ID"], infer=True)
    assert read.dtypes == [("ID", "int")]


def test_typing_step(spark):
    rows = [incident(), incident(ID="8", Date="2020-13-45", Ward="abc", Location="0.0")]
    typed = op.type_incidents(spark.createDataFrame(rows, INCIDENT_RAW))
    assert [(f.name, f.dataType) for f in typed.schema] == [
        (f.name, f.dataType) for f in INCIDENT_TYPED
    ]
    good, bad = typed.orderBy("ID").collect()
    assert (good.Date.hour, good.Ward, good.Community_Area, good.Arrest) == (0, 7, 8, True)
    assert (good.Location.lat, good.Location.long) == (41.8, -87.6)
    assert (bad.Date, bad.Ward, bad.Location) == (None, None, None)


def test_saved_table_and_views(spark, tmp_path):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    saved = sources.save_table(df, "blotter_saved", ["g"], str(tmp_path / "t"))
    assert saved.filter("g = 1").count() == 5
    plan = saved.filter("g = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(g" in plan
    sources.register(saved, "Mixed_Case")
    assert sources.scan_view(spark, "mixed_case").count() == 10
    spark.sql("DROP TABLE blotter_saved")


def test_cache_is_optional_and_spills(spark):
    cached = sources.keep_cached(spark.range(5))
    assert cached.count() == 5 and cached.storageLevel.useDisk
    cached.unpersist()


def test_concat_and_take_first(table):
    a = table([(3, "x"), (1, "y")], "k int, v string")
    b = table([("z", 2)], "v string, k int")
    both = sources.concat(a, b, b)
    assert both.count() == 4
    assert [r.k for r in sources.take_first(both, 2, "k").collect()] == [1, 2]


def test_lookup_text(table, spark):
    lines = table([("\n01\tNorth Side \t\n12  O'Hare\nno code\n",), ("3 Loop",)], "value string")
    got = {(r.code, r.name) for r in sources.parse_lookup_text(lines).collect()}
    assert got == {(1, "North Side"), (12, "O'Hare"), (3, "Loop")}
    areas = {r.code: r.name for r in sources.area_lookup(spark).collect()}
    assert sorted(areas) == list(range(1, 78))
    assert areas[25] == "Austin" and areas[76] == "O'Hare"


def test_files_with_other_column_orders_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n5,6\n")
    (tmp_path / "b c+d.csv").write_text("v,k,further\n3,4,x\n")
    (tmp_path / "c.csv").write_text('\ufeffV,"K"\n7,8\n')
    (tmp_path / "d.csv").write_text("k,v\n9,10\n")
    read = sources.read_incidents_csv(spark, str(tmp_path), required=["k", "v"])
    assert read.columns == ["k", "v"]
    assert sorted(tuple(map(int, r)) for r in read.collect()) == [(1, 2), (4, 3), (5, 6), (8, 7), (9, 10)]
    assert sorted(map(len, sources.csv_headers(spark, str(tmp_path)).values())) == [1, 1, 2]
    (tmp_path / "e.csv").write_text("k,w\n1,2\n")
    with pytest.raises(ValueError, match="'v'"):
        sources.read_incidents_csv(spark, str(tmp_path), required=["k", "v"])


def test_types_of_files_with_other_headers_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv").write_text("v,k\n3.5,x\n")
    read = sources.read_incidents_csv(spark, str(tmp_path), required=["k", "v"], infer=True)
    assert read.dtypes == [("k", "string"), ("v", "double")]
    assert {tuple(r) for r in read.collect()} == {("1", 2.0), ("x", 3.5)}


def test_first_rows_come_in_file_order(spark, tmp_path):
    for i, name in enumerate(["a", "b x", "c"]):
        folder = tmp_path / name
        spark.range(10 * i, 10 * i + 10).orderBy(F.desc("id")).coalesce(1).write.parquet(str(folder))
    whole = spark.read.parquet(*[str(tmp_path / n) for n in ("a", "b x", "c")])
    assert whole.count() == 30
    path = f"{tmp_path}/*"
    order = [*range(9, -1, -1), *range(19, 9, -1), *range(29, 19, -1)]
    for n in (0, 1, 10, 13, 29, 30, 99):
        df = sources.first_rows(spark, path, n, at_once=2)
        assert sorted(r.id for r in df.collect()) == sorted(order[:n]), n
    plan = sources.first_rows(spark, path, 13)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "/c/" not in plan
