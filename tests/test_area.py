from fixtures import action, actions, cities, products, tuples

from clicktide.operators import area as a


def test_area_top(spark):
    places = cities(
        spark, (1, "上海", "华东"), (2, "上海浦东", "华东"), (3, "海外A", "海外"), (4, "海外B", "其他")
    )
    goods = products(
        spark, (10, "ten", '{"product_status": 0}'), (11, "eleven", '{"product_status": 1}'),
        (12, "twelve", "{}"),
    )
    log = actions(
        spark,
        *[action("s", i, product=10, city=1) for i in range(3)], action("s", 9, product=10, city=2),
        *[action("s", i, product=11, city=1) for i in range(2)],
        *[action("s", i, product=p, city=2) for p in (12, 13, 0) for i in range(1)],
        action("s", 0, product=11, city=3), action("s", 0, product=12, city=4),
        action("s", 0, city=1), action("s", 0, product=10, city=99),
    )
    rows = {(r.area, r.product_id): r for r in a.area_top_products(a.product_clicks(log), places, goods).collect()}
    # three rows in 华东, the tie at rank three goes to the smallest id, and product 0 counts
    assert sorted(k for k in rows if k[0] == "华东") == [("华东", 0), ("华东", 10), ("华东", 11)]
    top = rows[("华东", 10)]
    # one city name inside another stays
    assert (top.area_level, top.click_count, top.city_infos) == ("A", 4, "上海,上海浦东")
    assert (top.product_name, top.product_status, top.product_status_label) == ("ten", 0, "自营")
    # a product without a row, and one without a status
    missing = rows[("华东", 0)]
    assert missing.product_name is None and missing.product_status is None
    assert rows[("其他", 12)].product_status is None and rows[("其他", 12)].product_status_label is None
    # areas without a level are ranked apart from each other
    assert rows[("海外", 11)].area_level is None and ("其他", 12) in rows


def test_levels(spark):
    names = spark.createDataFrame([(n,) for n in [*a.AREA_LEVELS, "X", None]], "area string")
    got = {r.area: r.level for r in names.select("area", a.area_level(names.area).alias("level")).collect()}
    assert got == {**a.AREA_LEVELS, "X": None, None: None}


def test_product_clicks_skips_other_actions(spark):
    log = actions(spark, action("s", 0, product=5, city=2), action("s", 1, city=2))
    assert tuples(a.product_clicks(log)) == [(2, 5)]
