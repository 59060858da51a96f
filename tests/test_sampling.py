import hashlib
from collections import Counter
from datetime import timedelta

import pytest
from fixtures import T0

from clicktide.operators import sampling as m

SCHEMA = "session_id string, start_time timestamp, search_keywords array<string>, click_category_ids array<bigint>"


def sessions(spark, counts):
    """counts: {(day offset, hour): n}"""
    rows = [
        (f"{d}-{h}-{i}", T0.replace(hour=h) + timedelta(days=d), [], [])
        for (d, h), n in counts.items() for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


COUNTS = {(0, 1): 30, (0, 2): 60, (0, 3): 9, (1, 1): 5, (2, 5): 1}


def quotas(counts, total):
    days = {d for d, _ in counts}
    share = total // len(days)
    day_count = Counter()
    for (d, _), n in counts.items():
        day_count[d] += n
    return {k: min(int(n / day_count[k[0]] * share), n) for k, n in counts.items()}


def smallest(ids, n, seed="0"):
    return sorted(ids, key=lambda s: (hashlib.md5(f"{seed}-{s}".encode()).hexdigest(), s))[:n]


@pytest.mark.parametrize("total", [100, 1000, 3])
def test_quota(spark, total):
    rows = m.sample_quota(sessions(spark, COUNTS), total).collect()
    got = {((r.date - T0.date()).days, r.hour): r.quota for r in rows}
    assert got == quotas(COUNTS, total)


def test_quota_of_nothing(spark):
    assert m.sample_quota(sessions(spark, {})).count() == 0
    assert m.session_sample(sessions(spark, {})).count() == 0
    assert m.session_sample_by_hour(sessions(spark, {})).count() == 0


@pytest.mark.parametrize("slack", [None, 0.0, 0.5, 1.0])
@pytest.mark.parametrize("total", [60, 3000])
def test_sample_is_exact_for_any_slack(spark, monkeypatch, slack, total):
    """Without slack some groups, or all, are left with too few rows and fall back to all of theirs."""
    if slack is not None:
        monkeypatch.setattr(m, "expected_below", lambda quota: quota * slack)
    want = sorted(
        s for (d, h), q in quotas(COUNTS, total).items()
        for s in smallest([f"{d}-{h}-{i}" for i in range(COUNTS[(d, h)])], q)
    )
    got = sorted(r.session_id for r in m.session_sample(sessions(spark, COUNTS), total).collect())
    assert got == want


def test_few_rows_of_a_hot_hour_go_on(spark, monkeypatch):
    """One hour has nearly all sessions: what is stored for the ranking is its quota and the slack."""
    kept = []
    real = m.materialize

    def watched(df, name):
        out = real(df, name)
        kept.append(out.count())
        return out

    monkeypatch.setattr(m, "materialize", watched)
    frame = sessions(spark, {(0, 1): 20_000, (0, 2): 50})
    got = {r.session_id for r in m.session_sample(frame, 100).collect()}
    assert got == {*smallest([f"0-1-{i}" for i in range(20_000)], 99)}
    assert len(kept) == 1 and kept[0] <= 99 + 6 * 10 + 16 + 5 * 14


def test_seed_changes_the_sample(spark):
    frame = sessions(spark, {(0, 1): 300})
    a, b = ({r.session_id for r in m.session_sample(frame, 100, seed).collect()} for seed in "ab")
    assert len(a) == len(b) == 100 and a != b


def test_by_hour(spark):
    counts = {(0, 1): 3, (1, 1): 2, (0, 2): 5}
    frame = sessions(spark, counts)
    shares = {r.hour: (r.session_count, r.share, r.quota) for r in m.hour_share(frame).collect()}
    # fewer than 100 sessions: the quota stops at what the hour has
    assert shares == {1: (5, 50.0, 5), 2: (5, 50.0, 5)}
    assert m.session_sample_by_hour(frame).count() == 10
    few = m.session_sample_by_hour(frame, 4).collect()
    ids = {1: [f"0-1-{i}" for i in range(3)] + [f"1-1-{i}" for i in range(2)],
           2: [f"0-2-{i}" for i in range(5)]}
    assert sorted(r.session_id for r in few) == sorted(s for h in ids for s in smallest(ids[h], 2))


def test_share_rounds_half_up(spark):
    rows = {r.hour: (r.share, r.quota) for r in m.hour_share(sessions(spark, {(0, 1): 1, (0, 2): 7})).collect()}
    assert rows == {1: (12.5, 1), 2: (87.5, 7)}
    rows = {r.hour: r.quota for r in m.hour_share(sessions(spark, {(0, 1): 25, (0, 2): 175}), 100).collect()}
    assert rows == {1: 13, 2: 88}


def test_detail_keeps_every_sampled_session(spark):
    frame = sessions(spark, {(0, 1): 20})
    log = frame.selectExpr(
        "1L as user_id", "session_id", "explode(array(1L, 2L)) as page_id", "start_time as action_time",
        *[f"cast(null as string) as {c}" for c in m.DETAIL_COLUMNS[4:]],
    )
    detail = m.session_sample_detail(log, frame, 10)
    assert detail.count() == 20 and detail.select("session_id").distinct().count() == 10
    assert detail.columns == list(m.DETAIL_COLUMNS)
