import os

import pytest
from fixtures import day, tuples

from clicktide.sources import schemas, tables
from clicktide.sources.tasks import TaskParams, find_task, task_params

KEYS = ["date", "user_id", "ad_id"]


def counts(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.AD_USER_CLICK_COUNT)


def current(spark, path):
    return tuples(tables.read_upserted(spark, path, schemas.AD_USER_CLICK_COUNT, KEYS))


@pytest.fixture
def path(spark, tmp_path):
    return tables.ensure_table(spark, str(tmp_path / "t"))


def test_upsert(spark, path):
    assert current(spark, path) == []
    tables.write_version(counts(spark, (day(1), 1, 1, 3), (day(1), 2, 1, 9)), path, 0, ["date"])
    tables.write_version(counts(spark, (day(1), 1, 1, 5), (day(2), 1, 1, 1)), path, 2, ["date"])
    want = [(day(1), 1, 1, 5), (day(1), 2, 1, 9), (day(2), 1, 1, 1)]
    assert current(spark, path) == want
    # the same batch again
    tables.write_version(counts(spark, (day(1), 1, 1, 5), (day(2), 1, 1, 1)), path, 2, ["date"])
    assert current(spark, path) == want


def versions(path, d):
    return sorted(f for f in os.listdir(f"{path}/date=2018-12-{d:02d}") if f.startswith("version"))


def test_compact(spark, path):
    schema = schemas.AD_USER_CLICK_COUNT
    for batch, n in enumerate((3, 4, 6)):
        rows = counts(spark, (day(1), 1, 1, n), (day(2), batch, 1, n))
        tables.write_version(rows, path, tables.batch_version(batch), ["date"])
    want = current(spark, path)
    tables.compact(spark, path, schema, KEYS, 1, ["date"])
    assert current(spark, path) == want
    # folded versions stay for readers under way ...
    assert versions(path, 1) == ["version=0", "version=2", "version=3", "version=4"]
    tables.compact(spark, path, schema, KEYS, 2, ["date"])
    # ... until the next compaction
    assert versions(path, 1) == ["version=3", "version=4", "version=5"]
    assert current(spark, path) == want
    tables.write_version(counts(spark, (day(1), 1, 1, 9)), path, tables.batch_version(3), ["date"])
    assert (day(1), 1, 1, 9) in current(spark, path)


def test_compact_within_dates(spark, path):
    from pyspark.sql import functions as F

    for batch in (0, 1):
        rows = counts(spark, (day(1), 1, 1, batch), (day(2), 1, 1, batch))
        tables.write_version(rows, path, tables.batch_version(batch), ["date"])
    only = F.col("date") == F.lit(day(2))
    tables.compact(spark, path, schemas.AD_USER_CLICK_COUNT, KEYS, 1, ["date"], only)
    assert versions(path, 1) == ["version=0", "version=2"]
    assert versions(path, 2) == ["version=0", "version=2", "version=3"]
    assert current(spark, path) == [(day(1), 1, 1, 1), (day(2), 1, 1, 1)]


def test_insert_absent(spark, path):
    def insert(version, *users):
        frame = spark.createDataFrame([(u,) for u in users], schemas.AD_BLACKLIST)
        tables.insert_absent(frame, path, schemas.AD_BLACKLIST, ["user_id"], version)

    def stored():
        return tuples(spark.read.schema(schemas.AD_BLACKLIST).parquet(path).select("user_id"))

    insert(0, 1, 2, 2)
    insert(2, 2, 3)
    insert(2, 2, 3)
    assert stored() == [(1,), (2,), (3,)]
    insert(4, 1, 2)
    assert stored() == [(1,), (2,), (3,)]
    tables.compact(spark, path, schemas.AD_BLACKLIST, ["user_id"], 2)
    assert tuples(tables.read_inserted(spark, path, schemas.AD_BLACKLIST)) == [(1,), (2,), (3,)]


def test_replace_groups(spark, path):
    schema, group = schemas.AD_PROVINCE_TOP3, ["date", "province"]

    def put(version, *rows):
        tables.write_version(spark.createDataFrame(list(rows), schema), path, version, ["date"])

    def stored():
        return tuples(tables.read_replaced(spark, path, schema, group))

    assert stored() == []
    put(0, (day(1), "P", 1, 5), (day(1), "P", 2, 4), (day(1), "Q", 1, 1))
    put(2, (day(1), "P", 3, 9))
    want = [(day(1), "P", 3, 9), (day(1), "Q", 1, 1)]
    assert stored() == want
    tables.compact(spark, path, schema, group, 1, ["date"], groups=True)
    assert stored() == want
    put(4, (day(1), "Q", 7, 3), (day(2), "P", 1, 1))
    tables.compact(spark, path, schema, group, 2, ["date"], groups=True)
    assert stored() == [(day(1), "P", 3, 9), (day(1), "Q", 7, 3), (day(2), "P", 1, 1)]


def test_publish_once(spark, tmp_path):
    target, staging = str(tmp_path / "clean/batch=0"), str(tmp_path / "staging/batch=0")
    assert tables.publish_once(spark.range(3), staging, target)
    assert not tables.publish_once(spark.range(5), staging, target)
    assert spark.read.parquet(target).count() == 3


def test_append(spark, tmp_path):
    rows = spark.createDataFrame([(7, 3, 2, 1)], "category_id bigint, click_count bigint, order_count bigint, pay_count bigint")
    for task in (1, 2):
        tables.append_result(rows, str(tmp_path), "top10_category", task)
    stored = spark.read.parquet(str(tmp_path / "top10_category"))
    assert stored.columns == list(schemas.RESULT_COLUMNS["top10_category"])
    assert tuples(stored) == [(1, 7, 3, 2, 1), (2, 7, 3, 2, 1)]


def task(spark, param):
    return spark.createDataFrame([(4, "t", None, None, None, "session", "new", param)], schemas.TASK)


def test_task_params(spark):
    tasks = task(
        spark,
        '{"startDate":["2018-12-01","x"],"startAge":["20"],"endAge":[50],"cities":["c1,c2"],'
        '"categoryIds":["1,2"],"keywords":[],"targetPageFlow":["1,2,3"]}',
    )
    assert find_task(tasks, 4) == TaskParams(
        4, start_date="2018-12-01", start_age=20, end_age=50, cities=("c1", "c2"),
        category_ids=(1, 2), target_page_flow=(1, 2, 3),
    )
    assert task_params(tasks).first().cities == "c1,c2"


def test_missing_task_is_an_error(spark):
    with pytest.raises(LookupError):
        find_task(task(spark, "{}"), 5)
    assert find_task(task(spark, "{}"), 4) == TaskParams(4)


def test_a_fold_looks_only_at_what_was_written(spark, path, monkeypatch):
    """A thousand idle dates: the fold lists and rewrites two of them."""
    from pathlib import Path

    for d in range(1000):
        Path(path, f"date=2015-{d // 28 % 12 + 1:02d}-{d % 28 + 1:02d}-{d}", "version=0").mkdir(parents=True)
    for batch in (0, 1):
        rows = counts(spark, (day(1), 1, 1, batch), (day(2), 1, 1, batch))
        tables.write_version(rows, path, tables.batch_version(batch), ["date"])
    looked = []
    real = tables._fs

    def watched(s, p):
        looked.append(p)
        return real(s, p)

    monkeypatch.setattr(tables, "_fs", watched)
    only = [str(day(1)), str(day(2))]
    tables.compact(spark, path, schemas.AD_USER_CLICK_COUNT, KEYS, 1, ["date"], only=only, folded_before=[str(day(3))])
    assert len(looked) <= 8 and not any("2015" in p or "*/" in p for p in looked)
    monkeypatch.setattr(tables, "_fs", real)
    assert versions(path, 1) == ["version=0", "version=2", "version=3"]


def test_insert_reads_the_touched_buckets_only(spark, path):
    frame = spark.createDataFrame([(u,) for u in range(2000)], schemas.AD_BLACKLIST)
    assert len(tables.insert_absent(frame, path, schemas.AD_BLACKLIST, ["user_id"], 0)) == tables.BUCKETS
    new = spark.createDataFrame([(5,), (9001,)], schemas.AD_BLACKLIST)
    touched = tables.insert_absent(new, path, schemas.AD_BLACKLIST, ["user_id"], 2)
    assert 1 <= len(touched) <= 2
    stored = tables.stored_in_buckets(spark, path, schemas.AD_BLACKLIST, touched)
    # no other file is listed
    assert {f.rsplit("bucket=", 1)[1].split("/")[0] for f in stored.inputFiles()} == {str(b) for b in touched}
    assert tables.read_inserted(spark, path, schemas.AD_BLACKLIST).count() == 2001
    second = tables.read_versions(spark, path, tables.bucketed(schemas.AD_BLACKLIST)).where("version = 2")
    assert [r.user_id for r in second.collect()] == [9001]
