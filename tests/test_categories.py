from fixtures import action, actions, tuples

from clicktide.operators import categories as c


def log(spark):
    return actions(
        spark,
        # 1 and 2 tie on clicks, 2 has the order; 3 and 4 tie on everything
        action("a", 0, category=1), action("a", 1, category=1),
        action("b", 2, category=2), action("b", 3, category=2),
        action("c", 4, category=3), action("c", 5, category=4),
        action("c", 6, category=0),
        action("d", 7, order="2,5"), action("d", 8, order="5,5"),
        action("d", 9, pay="0"), action("d", 10, pay="5,6"),
    )


def test_list_counts(spark):
    assert tuples(c.category_order_counts(log(spark))) == [(2, 1), (5, 3)]
    assert tuples(c.category_pay_counts(log(spark))) == [(0, 1), (5, 1), (6, 1)]


def test_top(spark):
    rows = [tuple(r) for r in c.top_categories(c.category_counts(log(spark))).collect()]
    # 0 is a category; 5 and 6 were never clicked
    assert rows == [(2, 2, 1, 0), (1, 2, 0, 0), (0, 1, 0, 1), (3, 1, 0, 0), (4, 1, 0, 0)]
    assert [r.category_id for r in c.top_categories(c.category_counts(log(spark)), 2).collect()] == [2, 1]


def test_top_with_unclicked(spark):
    rows = [r.category_id for r in c.top_categories(c.category_counts(log(spark)), include_unclicked=True).collect()]
    assert rows == [2, 1, 0, 3, 4, 5, 6]


def test_top_sessions(spark):
    rows = [action(f"s{i}", n, category=1) for i in range(12) for n in range(i + 1)]
    rows += [action("x", 0, category=2)] * 2 + [action("y", 0, category=9)]
    frame = actions(spark, *rows)
    top = spark.createDataFrame([(1,), (2,)], "category_id bigint")
    got = tuples(c.top_category_sessions(c.session_category_counts(frame), top))
    assert (2, "x", 2) in got and not any(r[0] == 9 for r in got)
    ones = sorted((r for r in got if r[0] == 1), key=lambda r: -r[2])
    assert [(r[1], r[2]) for r in ones] == [(f"s{i}", i + 1) for i in range(11, 1, -1)]


def test_per_session_counts_sum_to_the_same(spark):
    pairs = c.session_category_counts(log(spark))
    assert tuples(c.sum_sessions(pairs)) == tuples(c.category_counts(log(spark)))
    assert pairs.where("session_id = 'd' and category_id = 5").first().order_count == 3
