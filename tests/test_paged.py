"""The paged source over a folder of page files: whole, short, missing, broken and too many pages."""

import json

import pytest

from granary.sources import paged

SCHEMA = "id long, name string"


def folder(path, sizes, start=0):
    path.mkdir()
    n = start
    for page, size in enumerate(sizes):
        if size is None:
            continue
        rows = [{"name": f"n{n + k}", "id": n + k, "more": {"x": 1}} for k in range(size)] if isinstance(size, int) else size
        (path / f"{page * 10}.json").write_text(json.dumps(rows) if not isinstance(rows, str) else rows)
        n += size if isinstance(size, int) else 0
    return str(path)


def read(spark, path, **options):
    rows, complete, pages = paged.read_pages(spark, path, SCHEMA, pageRows=10, rangePages=2, **options)
    return sorted(r["id"] for r in rows.collect()), complete, pages


def test_pages(spark, tmp_path):
    assert read(spark, folder(tmp_path / "a", [10, 10, 10, 3])) == (list(range(33)), True, 4)
    assert read(spark, folder(tmp_path / "b", [10, 10, 0])) == (list(range(20)), True, 3)  # an empty page ends it too
    assert read(spark, folder(tmp_path / "c", [0])) == ([], True, 1)
    assert read(spark, folder(tmp_path / "d", [10, None, 10, 4]))[1] is False  # a page is missing
    assert read(spark, folder(tmp_path / "e", [10, "no json", 4]))[1] is False
    assert read(spark, folder(tmp_path / "f", [10, '{"error": "x"}', 4]))[1] is False
    assert read(spark, folder(tmp_path / "g", [10, 10, 10]), mostPages=3)[1] is False  # the limit was reached
    assert read(spark, folder(tmp_path / "h", [10, 4, 10, 2]))[:2] == (list(range(14)), True)  # what is behind a short page does not belong to it
    with pytest.raises(paged.IncompleteError):
        paged.whole(paged.read_pages(spark, str(tmp_path / "d"), SCHEMA, pageRows=10))
    assert paged.whole(paged.read_pages(spark, str(tmp_path / "a"), SCHEMA, pageRows=10)).count() == 33


def test_columns_and_filters(spark, tmp_path):
    path = folder(tmp_path / "a", [10, 10, 3])
    paged.register(spark)
    df = spark.read.format("paged").schema(SCHEMA).option("path", path).option("pageRows", 10).load()
    assert df.count() == 23 and df.rdd.getNumPartitions() == 10
    assert [r["name"] for r in df.filter("id >= 9 AND id < 12 AND name <> 'n10'").orderBy("id").collect()] == ["n9", "n11"]
    assert df.filter("id IN (2, 22, 99) AND name IS NOT NULL").select("name").count() == 2
    reader = paged.PagedReader(df.schema, {"path": path, "pageRows": "10"})
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    assert list(reader.pushFilters([EqualTo(("id",), 4), StringStartsWith(("name",), "n")])) == [StringStartsWith(("name",), "n")]
    assert list(reader.read(paged.Range(0, 5))) == [(4, "n4")]


def test_a_broken_page_is_an_error_where_nothing_tells_of_it(spark, tmp_path):
    path = folder(tmp_path / "a", [10, "no json"])
    paged.register(spark)
    with pytest.raises(Exception, match="page 1"):
        spark.read.format("paged").schema(SCHEMA).option("path", path).option("pageRows", 10).load().count()
