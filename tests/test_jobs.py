import pytest
from fixtures import action, actions, cities, products, tuples, users

from clicktide.plans import jobs
from clicktide.sources import schemas, tables


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    log = actions(
        spark,
        *[action(f"s{i}", 10 * n, user=i % 3, page=n + 1, category=n, product=n, city=1)
          for i in range(30) for n in range(4)],
        action("s1", 3 * 86400, user=1, page=1),  # outside the date range
    )
    tables.write_actions(log, str(base / "user_visit_action"))
    users(spark, (0, 20, "p", "c", "male"), (1, 30, "p", "c", "female"), (2, 70, "p", "c", "male")
          ).write.parquet(str(base / "user_info"))
    cities(spark, (1, "上海", "华东")).write.parquet(str(base / "city_info"))
    products(spark, (1, "one", '{"product_status": 1}')).write.parquet(str(base / "product_info"))
    param = ('{"startDate":["2018-12-14"],"endDate":["2018-12-15"],"startAge":["10"],"endAge":["50"],'
             '"targetPageFlow":["1,2,3"]}')
    spark.createDataFrame(
        [(1, "t", None, None, None, "session", "new", param), (2, "t", None, None, None, "page", "new", "{}")],
        schemas.TASK,
    ).write.parquet(str(base / "task"))
    return str(base)


def test_session_job(spark, base, tmp_path):
    results = str(tmp_path)
    jobs.run_session_job(spark, base, results, 1)

    def stored(name):
        frame = spark.read.parquet(f"{results}/{name}")
        assert frame.columns == list(schemas.RESULT_COLUMNS[name])
        return frame

    stat = stored("session_aggr_stat").first()
    assert (stat.task_id, stat.session_count) == (1, 20)
    assert stat.visit_length_10s_30s_ratio == 1.0 and stat.step_length_4_6_ratio == 1.0
    sample = stored("session_random_extract")
    assert sample.count() == 20 and sample.first().click_category_ids == "0,1,2,3"
    assert sample.first().start_time == "2018-12-14 06:20:00"
    assert stored("session_detail").count() == 80
    assert tuples(stored("top10_category")) == [(1, c, 20, 0, 0) for c in range(4)]
    assert stored("top10_category_session").count() == 40
    top = {r.product_id: r for r in stored("area_top3_product").collect()}
    assert sorted(top) == [0, 1, 2] and top[1].click_count == 30 and top[1].product_status == 1
    assert top[1].area_level == "A" and top[0].product_status is None


def test_page_flow_job(spark, base, tmp_path):
    jobs.run_page_flow_job(spark, base, str(tmp_path), 1)
    stored = spark.read.parquet(str(tmp_path / "page_split_convert_rate"))
    assert tuples(stored) == [(1, "1_2=1.0"), (1, "2_3=1.0")]
    with pytest.raises(ValueError):
        jobs.run_page_flow_job(spark, base, str(tmp_path), 2)
    with pytest.raises(LookupError):
        jobs.run_page_flow_job(spark, base, str(tmp_path), 3)


def test_command_line(spark, base, tmp_path, monkeypatch):
    from clicktide.__main__ import main

    def run(*args):
        monkeypatch.setattr("sys.argv", ["clicktide", *args])
        main()

    common = ["--tables", base, "--results", str(tmp_path), "--task-id", "1"]
    run("session", *common, "--sample-total", "5")
    assert spark.read.parquet(str(tmp_path / "session_random_extract")).count() == 5
    run("pageflow", *common)
    assert spark.read.parquet(str(tmp_path / "page_split_convert_rate")).count() == 2
    with pytest.raises(SystemExit):
        run("ads", "--tables", base)
