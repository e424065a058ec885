"""Stored tables: conforming, snapshots and the work folder."""

import pytest

from caseloom import schemas
from caseloom.sources import tables as T
from tests.helpers import dicts


def test_conform_adds_casts_and_defaults(spark):
    df = spark.createDataFrame([("c1", None, 1, "x"), ("c2", "Draft", 0, "y")],
                               "case_number string, case_status string, learning_eligible int, extra string")
    got = T.conform(df, schemas.CASES, schemas.CASE_DEFAULTS)
    assert got.schema.names == schemas.CASES.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in schemas.CASES]
    rows = dicts(got, "case_number")
    assert [r["case_status"] for r in rows] == ["AI Generated", "Draft"]
    assert [r["learning_eligible"] for r in rows] == [True, False]
    assert rows[0]["referenced_case_numbers"] == "[]" and rows[0]["reviewed_at"] is None


def test_conform_goes_by_name_at_any_depth(spark):
    given = "a struct<y: int, x: struct<b: string, a: string>>, `l.1` array<struct<v: int, k: string>>, m map<int, struct<b: int, a: int>>, s struct<P: int>"
    df = spark.createDataFrame([((1, ("B", "A")), [(7, "k"), None], {3: (2, 1)}, (5,)), (None, None, None, None)], given)
    wanted = "m map<string, struct<a: long, b: int, c: string>>, a struct<x: struct<a: string, b: string, c: int>, z: date>, `l.1` array<struct<k: string, v: string>>, s struct<p: int, q: int>, n struct<x: int>"
    got = T.conform(df, schemas.T.StructType.fromDDL(wanted))
    assert [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in schemas.T.StructType.fromDDL(wanted)]
    first, second = [r.asDict(recursive=True) for r in got.collect()]
    assert first == {
        "m": {"3": {"a": 1, "b": 2, "c": None}}, "a": {"x": {"a": "A", "b": "B", "c": None}, "z": None},
        "l.1": [{"k": "k", "v": "7"}, None], "s": {"p": 5, "q": None}, "n": None,
    }
    assert set(second.values()) == {None}


def test_snapshots(spark):
    root = T.new_path(spark, "snapshots")
    assert T.read_snapshot(spark, root, schemas.SEQUENCES) is None
    def counters(n):
        return spark.createDataFrame([("a", n, None)], schemas.SEQUENCES)

    for version, n in ((1, 10), (12, 120), (3, 30)):
        T.write_snapshot(counters(n), root, version)
    T.write_snapshot(counters(31), root, 3)
    def newest(below=None):
        return T.read_snapshot(spark, root, schemas.SEQUENCES, below).first()["last_value"]

    assert (newest(), newest(12), newest(3)) == (120, 31, 10)
    assert T.read_snapshot(spark, root, schemas.SEQUENCES, 1) is None


def test_partitioned_snapshot_reads_back(spark):
    root = T.new_path(spark, "catalog")
    rows = [("u1", "belt"), ("u2", "chain")]
    catalog = T.conform(spark.createDataFrame(rows, "product_url string, app_category_slug string"), schemas.PRODUCTS)
    T.write_snapshot(catalog, root, 1, ["app_category_slug"])
    back = T.read_snapshot(spark, root, schemas.PRODUCTS).select(*schemas.PRODUCTS.names)
    assert dicts(back, "product_url") == dicts(catalog, "product_url")


class _Session:
    """Just what work_dir asks of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default: folder)})


def test_work_folder():
    assert T.work_dir(_Session("spark://x", "s3://shared/work/")) == "s3://shared/work"
    with pytest.raises(RuntimeError):
        T.work_dir(_Session("yarn"))
    assert T.work_dir(_Session("local[2]")) == T.work_dir(_Session("local[2]"))


def test_staged_tables_are_released(spark):
    with T.collected() as made:
        first = T.stage(spark.range(3), "first")
        with T.collected() as inner:
            T.stage(spark.range(4), "inner")
    T.stage(spark.range(5), "outside")
    assert len(made) == len(inner) == 1 and first.count() == 3
    folder = spark._jvm.org.apache.hadoop.fs.Path(made[0])
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(folder)
    T.release(spark, made)
    assert made == [] and not fs.exists(folder)
    assert fs.exists(spark._jvm.org.apache.hadoop.fs.Path(inner[0]))
