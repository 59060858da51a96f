"""The registered queries as SQL for DuckDB, over the same tables.

The views restate plans/bindings.py; parameters restate plans/queries.py.
"""

from __future__ import annotations

VIEWS = {
    "ev": """
        SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
    """,
    "actions": """
        SELECT strftime(ts, '%Y-%m-%d') AS date,
               user_id,
               user_id || '-' || CAST(floor((epoch_us(ts) // 1000000 - 3600 * (user_id % 24)) / 86400) AS BIGINT)
                   AS session_id,
               CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
                    WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END AS BIGINT) AS page_id,
               ts AS action_time,
               CASE WHEN event_type = 'view' THEN 'kw' || (k % 10) END AS search_keyword,
               CASE WHEN event_type = 'click' THEN k END AS click_category_id,
               CASE WHEN event_type = 'click' THEN k END AS click_product_id,
               CASE WHEN event_type = 'signup' THEN k || ',' || ((k + 7) % 100) END AS order_category_ids,
               CASE WHEN event_type = 'signup' THEN k || ',' || ((k + 7) % 100) END AS order_product_ids,
               CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END AS pay_category_ids,
               CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END AS pay_product_ids,
               CAST(c_nationkey AS BIGINT) AS city_id
        FROM ev LEFT JOIN customer ON user_id = c_custkey
    """,
    "silences": """
        SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, true) AS begins
        FROM ev
    """,
    "gap_events": """
        SELECT *, CAST(sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM silences
    """,
    "gap_visits": """
        SELECT user_id, user_id || '-' || session_no AS session_id, ts,
               CASE WHEN event_type = 'view' THEN 'kw' || (k % 10) END AS search_keyword,
               CASE WHEN event_type = 'click' THEN k END AS click_category_id,
               CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
                    WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END AS page_id
        FROM gap_events
    """,
    "user_info": """
        SELECT c_custkey AS user_id, CAST(floor(c_acctbal / 100) AS INTEGER) AS age,
               c_mktsegment AS professional, n_name AS city,
               CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
        FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
    "city_info": """
        SELECT n_nationkey AS city_id, n_name AS city_name, r_name AS area,
               CASE r_name WHEN 'AFRICA' THEN 'A' WHEN 'AMERICA' THEN 'B' WHEN 'ASIA' THEN 'C'
                    WHEN 'EUROPE' THEN 'D' WHEN 'MIDDLE EAST' THEN 'E' END AS area_level
        FROM nation JOIN region ON n_regionkey = r_regionkey
    """,
    "product_info": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_partkey % 2 AS product_status,
               CASE WHEN p_partkey % 2 = 0 THEN '自营' ELSE '第三方' END AS product_status_label
        FROM part
    """,
    "product_clicks": """
        SELECT c_nationkey AS city_id, l_partkey AS product_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    """,
    "sessions": """
        SELECT session_id, max(user_id) AS user_id,
               coalesce(string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword), '')
                   AS search_keywords,
               coalesce(array_to_string(
                   list_sort(list(DISTINCT click_category_id) FILTER (click_category_id IS NOT NULL)), ','), '')
                   AS click_category_ids,
               (epoch_us(max(action_time)) - epoch_us(min(action_time))) // 1000 AS visit_length_ms,
               count(*) AS step_length,
               min(action_time) AS start_at,
               strftime(min(action_time), '%Y-%m-%d %H:%M:%S') AS start_time
        FROM actions GROUP BY session_id
    """,
    "enriched": "SELECT s.*, age, professional, city, sex FROM sessions s JOIN user_info USING (user_id)",
    "filtered": """
        SELECT * FROM enriched
        WHERE age BETWEEN 20 AND 60 AND professional IN ('BUILDING', 'HOUSEHOLD')
    """,
    "filtered_actions": """
        SELECT * FROM actions WHERE session_id IN (SELECT session_id FROM filtered)
    """,
    "clicks": """
        SELECT date_trunc('second', ts) AS event_time, strftime(ts, '%Y-%m-%d') AS date,
               replace(area, ' ', '_') AS province, city_name AS city, user_id, k % 5 AS ad_id,
               event_type, epoch_us(ts) // 1000 AS ms
        FROM ev JOIN customer ON ev.user_id = c_custkey JOIN city_info ON c_nationkey = city_info.city_id
    """,
    "daily": """
        SELECT date, user_id, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL
    """,
    "blacklist": "SELECT DISTINCT user_id FROM daily WHERE click_count > 2",
    "clean": "SELECT * FROM clicks WHERE user_id NOT IN (SELECT user_id FROM blacklist)",
    "stat": """
        SELECT date, province, city, ad_id, count(*) AS click_count FROM clean GROUP BY ALL
    """,
    "arrived": """
        SELECT *, CASE WHEN event_time < '2024-01-11 12:00:00' THEN 0
                       WHEN event_time < '2024-01-20 12:00:00' THEN 1 ELSE 2 END AS arrival
        FROM clicks WHERE event_type <> 'error'
    """,
    "arrived_listed": """
        SELECT user_id, min(arrival) AS listed
        FROM (SELECT user_id, arrival, sum(n) OVER (PARTITION BY date, user_id, ad_id ORDER BY arrival) AS total
              FROM (SELECT date, user_id, ad_id, arrival, count(*) AS n FROM arrived GROUP BY ALL))
        WHERE total > 2 GROUP BY user_id
    """,
    "arrived_clean": """
        SELECT a.* FROM arrived a LEFT JOIN arrived_listed l ON a.user_id = l.user_id
        WHERE l.listed IS NULL OR a.arrival < l.listed
    """,
    "hours": """
        SELECT strftime(start_at, '%Y-%m-%d') AS date, hour(start_at) AS hour,
               count(*) AS session_count
        FROM sessions GROUP BY ALL
    """,
    "quotas": """
        SELECT date, hour, session_count,
               CAST(least(floor(CAST(session_count AS DOUBLE)
                   / CAST(sum(session_count) OVER (PARTITION BY date) AS DOUBLE)
                   * CAST(3000 // (SELECT count(DISTINCT date) FROM hours) AS DOUBLE)), session_count)
                   AS BIGINT) AS quota
        FROM hours
    """,
    "drawn": """
        SELECT session_id FROM (
            SELECT session_id, quota,
                   row_number() OVER (PARTITION BY q.date, q.hour
                                      ORDER BY md5('0-' || session_id), session_id) AS rn
            FROM sessions s JOIN quotas q
              ON strftime(s.start_at, '%Y-%m-%d') = q.date AND hour(s.start_at) = q.hour)
        WHERE rn <= quota
    """,
    "hour_quota": """
        SELECT hour, session_count,
               CAST((200 * 100 * session_count + total) // (2 * total) AS DOUBLE) / 100 AS share,
               CAST(least((200 * session_count + total) // (2 * total), session_count) AS BIGINT) AS quota
        FROM (SELECT hour(start_at) AS hour, count(*) AS session_count,
                     (SELECT count(*) FROM sessions) AS total
              FROM sessions GROUP BY 1)
    """,
    "category_counts": """
        SELECT category_id, CAST(sum(click) AS BIGINT) AS click_count,
               CAST(sum(ord) AS BIGINT) AS order_count, CAST(sum(pay) AS BIGINT) AS pay_count
        FROM (
            SELECT click_category_id AS category_id, 1 AS click, 0 AS ord, 0 AS pay
            FROM filtered_actions WHERE click_category_id IS NOT NULL
            UNION ALL
            SELECT CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT), 0, 1, 0
            FROM filtered_actions WHERE order_category_ids IS NOT NULL
            UNION ALL
            SELECT CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT), 0, 0, 1
            FROM filtered_actions WHERE pay_category_ids IS NOT NULL)
        GROUP BY category_id
    """,
    "top_categories": """
        SELECT * FROM category_counts WHERE click_count > 0
        ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10
    """,
    "pairs": """
        SELECT lag(page_id) OVER (PARTITION BY session_id ORDER BY action_time, page_id) AS prev_page,
               page_id
        FROM actions
    """,
    "splits": """
        SELECT prev_page || '_' || page_id AS page_split, count(*) AS pv FROM pairs
        WHERE prev_page || '_' || page_id IN ('2_3', '3_4') GROUP BY 1
    """,
    "area_counts": """
        SELECT area, area_level, product_id, count(*) AS click_count,
               string_agg(DISTINCT city_name, ',' ORDER BY city_name) AS city_infos
        FROM product_clicks JOIN city_info USING (city_id) GROUP BY area, area_level, product_id
    """,
    "record": """
        SELECT session_id,
               'sessionid=' || session_id || '|searchKeywords=' || search_keywords
               || '|clickCategoryIds=' || click_category_ids || '|visitLength=' || visit_length_ms
               || '|stepLength=' || step_length || '|startTime=' || start_time || '|age=' || age
               || '|professional=' || professional || '|city=' || city || '|sex=' || sex || '|' AS info
        FROM enriched
    """,
}

SESSION_COLUMNS = """session_id, user_id, search_keywords, click_category_ids, visit_length_ms,
    step_length, start_time"""
USER_COLUMNS = SESSION_COLUMNS + ", age, professional, city, sex"

VISIT = (
    ("1s_3s", 0, 3), ("4s_6s", 3, 6), ("7s_9s", 6, 9), ("10s_30s", 9, 30), ("30s_60s", 30, 60),
    ("1m_3m", 60, 180), ("3m_10m", 180, 600), ("10m_30m", 600, 1800), ("30m", 1800, None),
)
STEP = (
    ("1_3", 0, 3), ("4_6", 3, 6), ("7_9", 6, 9), ("10_30", 9, 30), ("30_60", 30, 60), ("60", 60, None),
)
WIDE_VISIT = (
    ("under_1h", 0, 3600), ("1h_3h", 3600, 10800), ("3h_6h", 10800, 21600),
    ("6h_12h", 21600, 43200), ("12h", 43200, None),
)
NARROW_STEP = (("1", 0, 1), ("2", 1, 2), ("3_4", 2, 4), ("5", 4, None))


def _bucket(value: str, prefix: str, label: str, low: int, high: int | None) -> str:
    upper = "" if high is None else f" AND {value} <= {high}"
    return f"count(*) FILTER ({value} > {low}{upper}) AS {prefix}_{label}"


def _buckets(visit: tuple, step: tuple, source: str = "filtered") -> tuple[list[str], str]:
    parts = [_bucket("visit_length_ms // 1000", "visit_length", *x) for x in visit]
    parts += [_bucket("step_length", "step_length", *x) for x in step]
    names = [p.rsplit(" AS ", 1)[1] for p in parts]
    return names, f"SELECT count(*) AS session_count, {', '.join(parts)} FROM {source}"


def _ratios() -> str:
    names, sql = _buckets(VISIT, STEP)
    shares = [
        f"""CASE WHEN session_count = 0 THEN 0.0::DOUBLE
            ELSE CAST((200 * {n} + session_count) // (2 * session_count) AS DOUBLE) / 100 END AS {n}_ratio"""
        for n in names
    ]
    return f"SELECT session_count, {', '.join(shares)} FROM ({sql})"


def _percents() -> str:
    names, sql = _buckets(WIDE_VISIT, NARROW_STEP)

    def text(n: str) -> str:
        q = f"((20000 * {n} + session_count) // (2 * session_count))"
        return f"{q} // 100 || '.' || lpad(CAST({q} % 100 AS VARCHAR), 2, '0') || '%' AS {n}"

    return f"SELECT session_count, {', '.join(text(n) for n in names)} FROM ({sql})"


AREA_TOP = """
    SELECT area, area_level, product_id, city_infos, click_count, product_name, product_status,
           product_status_label
    FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS rn
          FROM {counts}) LEFT JOIN product_info USING (product_id)
    WHERE rn <= 3
"""

PROVINCE_TOP = """
    SELECT date, province, ad_id, click_count
    FROM (SELECT *, row_number() OVER (PARTITION BY date, province
                                       ORDER BY click_count DESC, ad_id) AS rn
          FROM (SELECT date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count
                FROM ({stat}) GROUP BY ALL))
    WHERE rn <= 3
"""

CLICK_ROW = """strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, date, province, city,
    user_id, ad_id"""

TREND = """
    SELECT date, hour(event_time) AS hour, minute(event_time) AS minute, ad_id,
           count(*) AS click_count
    FROM {clean} GROUP BY ALL
"""

BODIES = {
    "action_date_range": """
        SELECT date, user_id, session_id, page_id,
               strftime(action_time, '%Y-%m-%d %H:%M:%S') AS action_time, search_keyword,
               click_category_id, click_product_id, order_category_ids, order_product_ids,
               pay_category_ids, pay_product_ids, city_id
        FROM actions WHERE date BETWEEN '2024-01-05' AND '2024-01-20'
    """,
    "session_aggregate": f"SELECT {SESSION_COLUMNS} FROM sessions",
    "session_user_join": f"SELECT {USER_COLUMNS} FROM enriched",
    "session_filter": f"SELECT {USER_COLUMNS} FROM filtered",
    "session_keyword_filter": f"""
        SELECT {USER_COLUMNS} FROM enriched
        WHERE list_has_any(string_split(search_keywords, ','), ['kw1', 'kw4'])
    """,
    "session_category_filter": f"""
        SELECT {USER_COLUMNS} FROM enriched
        WHERE list_has_any(string_split(click_category_ids, ','), ['3', '14', '15']) AND sex = 'male'
    """,
    "session_condition_filter": f"""
        SELECT {USER_COLUMNS} FROM enriched
        WHERE age BETWEEN 20 AND 60 AND sex = 'male' AND professional = 'BUILDING'
    """,
    "filtered_session_actions": """
        SELECT date, user_id, session_id, page_id,
               strftime(action_time, '%Y-%m-%d %H:%M:%S') AS action_time, search_keyword,
               click_category_id, order_category_ids, pay_category_ids, city_id
        FROM filtered_actions
    """,
    "session_histogram": _buckets(VISIT, STEP)[1],
    "session_histogram_wide": _buckets(WIDE_VISIT, NARROW_STEP)[1],
    "session_histogram_searched": _buckets(
        WIDE_VISIT, NARROW_STEP,
        """(SELECT * FROM enriched
            WHERE list_has_any(string_split(search_keywords, ','), ['kw1', 'kw4'])
              AND list_has_any(string_split(click_category_ids, ','),
                               list_transform(range(50), lambda i: CAST(i AS VARCHAR))))""",
    )[1],
    "session_aggr_stat": _ratios(),
    "session_histogram_percent": _percents(),
    "category_order_counts": """
        SELECT CAST(c AS BIGINT) AS category_id, count(*) AS order_count
        FROM (SELECT unnest(string_split(order_category_ids, ',')) AS c FROM actions) GROUP BY 1
    """,
    "category_pay_counts": """
        SELECT CAST(c AS BIGINT) AS category_id, count(*) AS pay_count
        FROM (SELECT unnest(string_split(pay_category_ids, ',')) AS c FROM actions) GROUP BY 1
    """,
    "top10_categories": "SELECT * FROM top_categories",
    "top10_category_sessions": """
        SELECT category_id, session_id, click_count
        FROM (SELECT *, row_number() OVER (PARTITION BY category_id
                                           ORDER BY click_count DESC, session_id) AS rn
              FROM (SELECT click_category_id AS category_id, session_id, count(*) AS click_count
                    FROM filtered_actions
                    WHERE click_category_id IN (SELECT category_id FROM top_categories)
                    GROUP BY ALL))
        WHERE rn <= 10
    """,
    "page_split_counts": "SELECT * FROM splits",
    "gap_sessions": "SELECT event_id, user_id, session_no FROM gap_events",
    "gap_session_aggregate": """
        SELECT session_id, max(user_id) AS user_id,
               coalesce(string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword), '') AS search_keywords,
               coalesce(array_to_string(
                   list_sort(list(DISTINCT click_category_id) FILTER (click_category_id IS NOT NULL)), ','), '')
                   AS click_category_ids,
               (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS visit_length_ms,
               count(*) AS step_length, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time
        FROM gap_visits GROUP BY session_id
    """,
    "gap_page_split_counts": """
        SELECT prev_page || '_' || page_id AS page_split, count(*) AS pv
        FROM (SELECT page_id, lag(page_id) OVER (PARTITION BY session_id ORDER BY ts, page_id) AS prev_page FROM gap_visits)
        WHERE prev_page || '_' || page_id IN ('2_3', '3_4') GROUP BY 1
    """,
    "start_page_visits": "SELECT count(*) AS start_page_visits FROM actions WHERE page_id = 2",
    "page_convert_rate": """
        SELECT step_no, page_split, pv,
               CASE WHEN prev = 0 OR visits = 0 THEN 0.0::DOUBLE
                    ELSE CAST((200 * pv + prev) // (2 * prev) AS DOUBLE) / 100 END AS convert_rate
        FROM (SELECT step_no, page_split, pv, visits,
                     coalesce(lag(pv) OVER (ORDER BY step_no), visits) AS prev
              FROM (SELECT CAST(step_no AS BIGINT) AS step_no, f.page_split, coalesce(pv, 0) AS pv,
                           (SELECT count(*) FROM actions WHERE page_id = 2) AS visits
                    FROM (VALUES (1, '2_3'), (2, '3_4')) f(step_no, page_split)
                    LEFT JOIN splits USING (page_split)))
    """,
    "area_level_label": """
        SELECT CAST(city_id AS BIGINT) AS city_id, city_name, area, area_level, count(*) AS click_count
        FROM product_clicks JOIN city_info USING (city_id) GROUP BY ALL
    """,
    "area_product_clicks": "SELECT area, area_level, product_id, click_count FROM area_counts",
    "area_top3_products": AREA_TOP.format(counts="area_counts"),
    "area_top3_clicked": AREA_TOP.format(
        counts="""(SELECT area, area_level, click_product_id AS product_id, count(*) AS click_count,
                          string_agg(DISTINCT city_name, ',' ORDER BY city_name) AS city_infos
                   FROM actions JOIN city_info USING (city_id)
                   WHERE click_product_id IS NOT NULL GROUP BY ALL)"""
    ),
    "sessions_per_hour": "SELECT * FROM hours",
    "hour_share": "SELECT * FROM hour_quota",
    "sample_quota": "SELECT * FROM quotas",
    "session_sample": """
        SELECT session_id, start_time, search_keywords, click_category_ids FROM sessions
        WHERE session_id IN (SELECT session_id FROM drawn)
    """,
    "session_sample_by_hour": """
        SELECT session_id, start_time, search_keywords, click_category_ids, hour
        FROM (SELECT s.*, q.hour, quota,
                     row_number() OVER (PARTITION BY q.hour
                                        ORDER BY md5('0-' || session_id), session_id) AS rn
              FROM sessions s JOIN hour_quota q ON hour(s.start_at) = q.hour)
        WHERE rn <= quota
    """,
    "session_sample_detail": """
        SELECT user_id, session_id, page_id,
               strftime(action_time, '%Y-%m-%d %H:%M:%S') AS action_time, search_keyword,
               click_category_id, click_product_id, order_category_ids, order_product_ids,
               pay_category_ids, pay_product_ids
        FROM actions WHERE session_id IN (SELECT session_id FROM drawn)
    """,
    "session_record_encode": "SELECT session_id || chr(1) || info AS value FROM record",
    "session_record_decode": """
        SELECT session_id, search_keywords, click_category_ids, visit_length_ms, step_length,
               start_time, age, professional, city, sex
        FROM enriched
    """,
    "session_record_fields": """
        SELECT r.session_id, nullif(search_keywords, '') AS keywords, CAST(NULL AS VARCHAR) AS absent,
               rtrim(replace(info, '|city=' || city || '|', '|city=X$1|'), '|') AS changed
        FROM record r JOIN enriched USING (session_id)
    """,
    "scalar_text_dates": """
        SELECT o_orderkey,
               o_orderpriority = '5-LOW' AS no_priority,
               o_orderpriority <> '5-LOW' AS has_priority,
               o_orderpriority AS trimmed,
               lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS two_digits,
               strftime(o_orderdate, '%Y-%m-%d') AS order_date,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_time,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed_time,
               strftime(o_orderdate, '%Y-%m-%d_%H') AS date_hour,
               strftime(o_orderdate, '%Y%m%d') AS date_key,
               strftime(o_orderdate, '%Y-%m-%d') AS parsed_key,
               strftime(o_orderdate, '%Y%m%d%H%M') AS minute_key,
               strftime(o_orderdate + INTERVAL 789 MILLISECOND, '%Y-%m-%d %H:%M:%S') AS stamp,
               o_orderdate < TIMESTAMP '2024-01-01' AS before_base,
               o_orderdate > TIMESTAMP '2024-01-01' AS after_base,
               CAST(floor(epoch(o_orderdate)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT)
                   AS seconds_from_base,
               round(o_totalprice / 7, 2) AS price_rounded, CAST(86400 AS BIGINT) AS day_seconds
        FROM orders
    """,
    "json_field": "SELECT * FROM product_info",
    "task_params": """
        SELECT c_custkey AS task_id, '2024-01-01' AS start_date, CAST(NULL AS VARCHAR) AS end_date,
               CASE WHEN c_custkey % 3 <> 0 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS start_age,
               CASE WHEN c_custkey % 3 <> 0 THEN CAST(60 AS BIGINT) END AS end_age,
               c_mktsegment || ',BUILDING' AS professionals, 'NATION_' || c_nationkey AS cities,
               CAST(NULL AS VARCHAR) AS sex, CAST(NULL AS VARCHAR) AS keywords,
               CAST(NULL AS VARCHAR) AS category_ids, '1,2,3' AS target_page_flow
        FROM customer
    """,
    "ad_log_parse": f"SELECT {CLICK_ROW} FROM clicks WHERE event_type <> 'error'",
    "ad_log_rejects": """
        SELECT ms || ' ' || province || ' ' || city || ' ' || user_id AS value
        FROM clicks WHERE event_type = 'error'
    """,
    "ad_user_daily_clicks": "SELECT * FROM daily",
    "ad_blacklist": "SELECT * FROM blacklist",
    "ad_blacklist_filter": f"SELECT {CLICK_ROW} FROM clean",
    "ad_stat": "SELECT * FROM stat",
    "ad_province_counts": """
        SELECT date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count
        FROM stat GROUP BY ALL
    """,
    "ad_province_top3": PROVINCE_TOP.format(stat="SELECT * FROM stat"),
    "ad_click_trend": TREND.format(clean="clean"),
    "ad_click_trend_last_hour": f"""
        SELECT * FROM ({TREND.format(clean="clean")})
        WHERE CAST(date AS TIMESTAMP) + to_minutes(60 * hour + minute) >
              (SELECT date_trunc('minute', max(event_time)) FROM clicks) - INTERVAL 1 HOUR
    """,
    "ad_restart": """
        SELECT date, user_id, ad_id, count(*) AS click_count FROM clicks
        WHERE event_type <> 'error' GROUP BY ALL
    """,
    "sink_append_roundtrip": """
        WITH listed AS (
            SELECT date, click_category_id AS c, 1 AS click, 0 AS ord, 0 AS pay
            FROM actions WHERE click_category_id IS NOT NULL
            UNION ALL
            SELECT date, CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT), 0, 1, 0 FROM actions
            UNION ALL
            SELECT date, CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT), 0, 0, 1 FROM actions),
        task AS (
            SELECT CAST(1 AS BIGINT) AS task_id, * FROM listed
            UNION ALL
            SELECT CAST(2 AS BIGINT), * FROM listed WHERE date BETWEEN '2024-01-05' AND '2024-01-20'),
        counted AS (
            SELECT task_id, c AS category_id, CAST(sum(click) AS BIGINT) AS click_count,
                   CAST(sum(ord) AS BIGINT) AS order_count, CAST(sum(pay) AS BIGINT) AS pay_count
            FROM task GROUP BY ALL HAVING sum(click) > 0)
        SELECT task_id, category_id, click_count, order_count, pay_count
        FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY click_count DESC,
                        order_count DESC, pay_count DESC, category_id) AS rn FROM counted)
        WHERE rn <= 10
    """,
    "sink_upsert_roundtrip": """
        SELECT date, province, city, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL
    """,
    "sink_replace_group_roundtrip": PROVINCE_TOP.format(
        stat="""SELECT date, province, city, ad_id, count(*) AS click_count FROM clicks
                WHERE date >= '2024-01-16' OR hour(event_time) < 12 GROUP BY ALL"""
    ),
    "sink_insert_absent_roundtrip": "SELECT * FROM blacklist",
}

_ARRIVED_STAT = "SELECT date, province, city, ad_id, count(*) AS click_count FROM arrived_clean GROUP BY ALL"
# A user's clicks pass until the arrival in which the user is listed.
BODIES |= {
    "ad_user_daily_clicks_stream": BODIES["ad_restart"],
    "ad_blacklist_stream": "SELECT user_id FROM arrived_listed",
    "ad_blacklist_filter_stream": f"SELECT {CLICK_ROW} FROM arrived_clean",
    "ad_stat_stream": _ARRIVED_STAT,
    "ad_province_top3_stream": PROVINCE_TOP.format(stat=_ARRIVED_STAT),
    "ad_click_trend_stream": TREND.format(clean="arrived_clean"),
    # panes of five seconds; the hour ends with that of the newest click
    "ad_click_trend_hour_stream": TREND.format(clean="""(
            SELECT * FROM arrived_clean WHERE epoch_us(event_time) // 5000000 >
                (SELECT max(epoch_us(event_time)) // 5000000 - 720 FROM arrived))"""),
    "ad_log_rejects_stream": BODIES["ad_log_rejects"],
    # the newest arrival comes first and closes the days that end two days before its newest click
    "ad_late_clicks_stream": f"""
        SELECT {CLICK_ROW} FROM arrived
        WHERE arrival < 2 AND CAST(date AS DATE) + INTERVAL 1 DAY <=
              (SELECT max(event_time) FROM arrived) - INTERVAL 2 DAY
    """,
}


for _sink, _name, _columns in (
    ("session_aggr_stat", "session_aggr_stat", "*"),
    ("session_random_extract", "session_sample", "*"),
    ("session_detail", "session_sample_detail", "*"),
    ("top10_category", "top10_categories", "*"),
    ("top10_category_session", "top10_category_sessions", "*"),
    ("area_top3_product", "area_top3_clicked", "area, product_id, click_count, product_name, product_status"),
    ("page_split_convert_rate", "page_convert_rate", "page_split || '=' || CAST(convert_rate AS VARCHAR) AS convert_rate"),
):
    BODIES[f"sink_{_sink}"] = f"SELECT CAST(1 AS BIGINT) AS task_id, {_columns} FROM ({BODIES[_name]})"


def _mentions(sql: str, name: str) -> bool:
    tokens = "".join(c if c.isalnum() or c == "_" else " " for c in sql).split()
    return name in tokens


def with_views(body: str) -> str:
    """``body`` preceded by the views it needs, in their order above."""
    needed: list[str] = []
    text = body
    for name in reversed(VIEWS):
        if _mentions(text, name):
            needed.insert(0, name)
            text += VIEWS[name]
    views = [f"{n} AS ({VIEWS[n]})" for n in needed]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(views)}, {body[5:]}"
    return f"WITH {', '.join(views)} {body}" if views else body


def oracle() -> dict[str, str]:
    return {name: with_views(body) for name, body in BODIES.items()}
