import pytest
from fixtures import action, actions, at, tuples, users
from pyspark.sql import functions as F

from clicktide.operators import sessions as s
from clicktide.sources import readers, tables


def by_id(df):
    return {r.session_id: r for r in df.collect()}


def test_aggregate(spark):
    rows = by_id(s.aggregate_sessions(actions(
        spark,
        action("a", 0, keyword="新辣道鱼火锅"),
        action("a", 61.5, keyword="火锅"),
        action("a", 10, category=21),
        action("a", 20, category=10),
        action("a", 30, category=1),
        action("a", 40, category=0),
        action("a", 50, category=10),
        action("b", 5, keyword=""),
    )))
    a, b = rows["a"], rows["b"]
    # historical sessions end at their last action
    assert (a.visit_length_ms, a.step_length, a.start_time) == (61500, 7, at(0))
    # 1 after 10 and 21, and a keyword contained in another, are kept; 0 is a category
    assert a.click_category_ids == [0, 1, 10, 21]
    assert sorted(a.search_keywords) == sorted(["新辣道鱼火锅", "火锅"])
    assert (b.visit_length_ms, b.step_length) == (0, 1)
    assert b.search_keywords == [] and b.click_category_ids == []


def test_long_session_does_not_overflow(spark):
    row = s.aggregate_sessions(actions(spark, action("a", 0), action("a", 40 * 86400))).first()
    assert row.visit_length_ms == 40 * 86400 * 1000


@pytest.fixture(scope="module")
def enriched(spark):
    log = actions(
        spark,
        action("s1", 0, user=1, keyword="kw1"), action("s1", 1, user=1, category=10),
        action("s2", 0, user=2, category=1),
        action("s3", 0, user=3, keyword="kw10"), action("s3", 1, user=3, category=0),
        action("s4", 0, user=9),
    )
    people = users(
        spark, (1, 20, "p1", "c1", "male"), (2, 50, "p2", "c2", "female"), (3, 51, "p1", "c2", "male")
    )
    return s.join_users(s.aggregate_sessions(log), people).persist()


def kept(enriched, **params):
    return sorted(r.session_id for r in s.filter_sessions(enriched, s.SessionFilter(**params)).collect())


def test_unknown_user_is_dropped(enriched):
    assert sorted(r.session_id for r in enriched.collect()) == ["s1", "s2", "s3"]


@pytest.mark.parametrize(
    "params, want",
    [
        ({}, ["s1", "s2", "s3"]),
        ({"start_age": 30}, ["s1", "s2", "s3"]),
        ({"end_age": 30}, ["s1", "s2", "s3"]),
        ({"start_age": 20, "end_age": 50}, ["s1", "s2"]),
        ({"professionals": ("p1",)}, ["s1", "s3"]),
        ({"cities": ("c1", "c2")}, ["s1", "s2", "s3"]),
        ({"sex": ("female",)}, ["s2"]),
        ({"keywords": ("kw1", "zz")}, ["s1"]),
        ({"category_ids": (1,)}, ["s2"]),
        ({"category_ids": (0, 10)}, ["s1", "s3"]),
        ({"professionals": ("p1",), "category_ids": (0,)}, ["s3"]),
    ],
)
def test_filter(enriched, params, want):
    assert kept(enriched, **params) == want


@pytest.mark.parametrize(
    "params",
    [{}, {"keywords": ("kw1",)}, {"category_ids": (0, 10)}, {"keywords": ("kw1",), "category_ids": (10,)},
     {"keywords": ("kw1",), "category_ids": (1,)}, {"sex": ("male",), "keywords": ("kw10", "x")}],
)
def test_hits_filter_like_lists(spark, params):
    log = actions(
        spark,
        action("s1", 0, user=1, keyword="kw1"), action("s1", 1, user=1, category=10),
        action("s2", 0, user=2, category=1), action("s2", 1, user=2, keyword=""),
        action("s3", 0, user=1, keyword="kw10"), action("s3", 1, user=1, category=0),
    )
    people = users(spark, (1, 20, "p", "c", "male"), (2, 30, "p", "c", "female"))
    params = s.SessionFilter(**params)
    by_lists = s.filter_sessions(s.join_users(s.aggregate_sessions(log), people), params)
    by_hits = s.filter_sessions(s.join_users(s.aggregate_sessions(log, params), people), params)
    assert by_hits.columns == by_lists.columns
    assert tuples(by_hits) == tuples(by_lists)


def test_equal_if(enriched):
    assert enriched.where(s.equal_if("city", "c1")).count() == 1
    assert enriched.where(s.equal_if("city", None)).count() == 3


def test_conditions(enriched):
    def ids(*conditions):
        return sorted(r.session_id for r in s.filter_conditions(enriched, *conditions).collect())

    assert ids() == ["s1", "s2", "s3"]
    assert ids("age:20-50") == ["s1", "s2"]
    assert ids("sex:male", "professional:p1", "city:c2") == ["s3"]
    with pytest.raises(ValueError):
        ids("height:3")


VISITS = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
STEPS = [1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61]


def test_histogram_edges(spark):
    lengths = spark.createDataFrame(
        [(v * 1000 + 999 if v else 999, 1) for v in VISITS] + [(0, n) for n in STEPS],
        "visit_length_ms bigint, step_length bigint",
    )
    row = s.session_histogram(lengths).first().asDict()
    assert row["session_count"] == len(VISITS) + len(STEPS)
    visits = [row[f"visit_length_{label}"] for label, _, _ in s.VISIT_SECONDS]
    # milliseconds are cut: 999 ms is no second, 3999 ms is three
    assert visits == [2, 2, 2, 2, 2, 2, 2, 2, 1]
    steps = [row[f"step_length_{label}"] for label, _, _ in s.STEP_COUNTS]
    assert steps == [2 + len(VISITS), 2, 2, 2, 2, 1]
    assert sum(visits) + 1 + len(STEPS) == row["session_count"]
    assert sum(steps) == row["session_count"]


def test_ratios_and_percent(spark):
    lengths = spark.createDataFrame([(1000, 1), (4000, 5), (4000, 1)], "visit_length_ms bigint, step_length bigint")
    hist = s.session_histogram(lengths)
    stat = s.session_aggr_stat(hist).first()
    assert stat.visit_length_1s_3s_ratio == 0.33 and stat.visit_length_4s_6s_ratio == 0.67
    percent = s.histogram_percent(hist).first()
    assert percent.step_length_1_3 == "66.67%" and percent.step_length_60 == "0.00%"


def test_no_sessions(spark):
    empty = spark.createDataFrame([], "visit_length_ms bigint, step_length bigint")
    row = s.session_aggr_stat(s.session_histogram(empty)).first()
    assert row.session_count == 0 and row.visit_length_30m_ratio == 0.0


def test_counting_twice_gives_the_same(spark, enriched):
    hist = s.session_histogram(enriched)
    assert hist.first() == hist.first()


def test_of_sessions(spark, enriched):
    log = actions(spark, action("s1", 0), action("s1", 1), action("s9", 2))
    assert s.of_sessions(log, enriched).count() == 2


def test_record_round_trip(spark, enriched, tmp_path):
    encoded = s.encode_sessions(enriched)
    line = next(r.value for r in encoded.collect() if r.value.startswith("s1"))
    assert line == (
        "s1\x01sessionid=s1|searchKeywords=kw1|clickCategoryIds=10|visitLength=1000|stepLength=2"
        "|startTime=2018-12-14 06:20:00|age=20|professional=p1|city=c1|sex=male|"
    )
    tables.write_session_text(encoded, str(tmp_path / "t"))
    back = s.decode_sessions(readers.read_session_text(spark, str(tmp_path / "t")))
    assert tuples(back) == tuples(enriched.select(*back.columns))


def test_decode_foreign_records(spark):
    """A field named twice counts once; empty and broken fields are absent."""
    text = "s\x01sessionid=s|visitLength=5|visitLength=6|stepLength=x|startTime=2018-12-14 6:20:00|city=a=b|age=|"
    lines = spark.createDataFrame([(text,), ("only-id",)], "value string")
    first, second = s.decode_sessions(lines).orderBy(F.desc("session_id")).collect()
    assert (first.visit_length_ms, first.step_length, first.city, first.age) == (5, None, None, None)
    assert first.start_time == at(0) and first.search_keywords == []
    assert second.session_id == "only-id" and second.visit_length_ms is None


def test_date_range(spark):
    log = actions(spark, *[action("s", d * 86400) for d in range(4)])

    def count(start, end):
        return readers.action_date_range(log, start, end).count()

    assert count("2018-12-15", "2018-12-16") == 2
    assert count(None, "2018-12-15") == 2
    assert count("2018-12-16", None) == 2
    assert count(None, None) == 4


def test_partitioned_log_prunes(spark, tmp_path):
    log = actions(spark, *[action("s", d * 86400) for d in range(4)])
    path = str(tmp_path / "user_visit_action")
    tables.write_actions(log, path)
    stored = readers.read_table(spark, str(tmp_path), "user_visit_action")
    assert tuples(stored.select(*log.columns)) == tuples(log)
    day = readers.action_date_range(stored, "2018-12-15", "2018-12-15").select(F.col("session_id"))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
