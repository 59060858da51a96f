from conftest import SMALL

import brute
from clicktide.llm import warc
from clicktide.llm.common import table
from clicktide.llm.queries import QUERIES

KEY = lambda r: tuple((x is not None, x) for x in r)


def test_query(spark):
    pages = [(r.page_id, r.html) for r in table(spark, SMALL, "pages").collect()]
    got = [tuple(r) for r in QUERIES["op9_warc"](spark, SMALL).collect()]
    assert sorted(got, key=KEY) == sorted(brute.warc(pages), key=KEY)


def test_strange_pages(spark):
    big = "é" * 60
    rows = [
        (5, "u5", big), (3, "u3", big), (4, None, big), (6, "x\r\ny", "small"), (7, "u7", "small"), (8, "u", None), (9, "u", ""),
        (10, "u", "\r\n\r\nWARC/1.1" * 30), (11, "u", "\r\n\r\nWARC/1.1" * 30), (12, "u", "long " * 300_000), (13, "u", "long " * 300_000),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to", "3 as n")
    got = [tuple(r) for r in warc.archived(df).collect()]
    assert sorted(got, key=KEY) == sorted(brute.warc([(r[0], r[2]) for r in rows]), key=KEY)
    assert warc.archived(df.where("false")).count() == 0


def test_repeated_rows_and_no_id(spark):
    big = "x" * 200
    rows = [(1, "a", big), (1, "a", big), (2, "b", big), (None, "c", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((tuple(r) for r in warc.archived(df).collect()), key=KEY)
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [
        (None, 200, "response", None), (1, 200, "response", None), (1, 200, "response", None), (2, 200, "revisit", 1)]


def test_revisits_hold_no_payload(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "<p>" + "same" * 500) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}"
    files = warc.write_archives(warc.plan_records(df), folder)
    read = warc.read_archives(files, folder).orderBy("page_id").collect()
    assert [r.payload is None for r in read] == [False, True, True, True, True]
    assert bytes(read[0].payload).decode() == rows[0][2] and read[3].url == "http://h/3" and read[3].refers_to == 0
