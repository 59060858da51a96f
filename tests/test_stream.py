"""Streams against the batch operators, over several files, restarts and late rows."""

import os
import random
from datetime import datetime, timedelta

import pytest
from fixtures import tuples
from pyspark.sql import functions as F

from clicktide.operators import ads
from clicktide.sources import readers
from clicktide.streaming import ad_stream as p

T = datetime(2018, 12, 17, 23, 0, 0)
THRESHOLD = 5


def make_lines(n=600, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = T + timedelta(seconds=10 * i)
        ms = int((t - datetime(1970, 1, 1)).total_seconds() * 1000) + rnd.randrange(1000)
        user = 0 if rnd.random() < 0.34 else rnd.randrange(1, 40)  # one user with a third of all
        province = f"P{rnd.randrange(3)}"
        out.append(f"{ms} {province} {province}c{rnd.randrange(2)} {user} {rnd.randrange(5)}")
    return out


class Landing:
    def __init__(self, folder):
        self.folder, self.n = folder, 0
        folder.mkdir()

    def add(self, texts):
        file = self.folder / f"{self.n:04d}.txt"
        file.write_text("\n".join(texts) + "\n")
        os.utime(file, (10**9 + self.n, 10**9 + self.n))  # files are read in this order
        self.n += 1


@pytest.fixture
def landing(tmp_path):
    return Landing(tmp_path / "landing")


@pytest.fixture
def out(tmp_path):
    return p.AdTables(str(tmp_path / "out"))


def stream(spark, landing, max_files=1):
    return ads.parse_ad_lines(readers.read_text_stream(spark, str(landing.folder), max_files))


def batch(spark, landing):
    return ads.parse_ad_lines(spark.read.text(str(landing.folder)))


def passed(spark, landing):
    """The clicks that pass, by the order of the files: until the one in which the user is listed."""
    counts, listed, kept = {}, set(), []
    for file in sorted(landing.folder.iterdir()):
        rows = ads.parse_ad_lines(spark.read.text(str(file))).collect()
        for r in rows:
            key = (r.date, r.user_id, r.ad_id)
            counts[key] = counts.get(key, 0) + 1
            if counts[key] > THRESHOLD:
                listed.add(r.user_id)
        kept += [tuple(r) for r in rows if r.user_id not in listed]
    return sorted(kept)


def check_against_batch(spark, out, clicks):
    assert tuples(out.user_click_count(spark)) == tuples(ads.user_daily_clicks(clicks))
    listed = ads.blacklist(clicks, THRESHOLD)
    assert tuples(out.blacklist(spark)) == tuples(listed) and listed.count() > 0
    clean = out.clean(spark)
    assert tuples(out.stat(spark)) == tuples(ads.ad_stat(clean))
    top = ads.province_top(ads.ad_stat(clean)).select("date", "province", "ad_id", "click_count")
    assert tuples(out.province_top3(spark).select(*top.columns)) == tuples(top)
    trend = ads.click_trend(clean)
    assert tuples(out.trend(spark)) == tuples(trend.select(*out.trend(spark).columns))
    check_hour(spark, out, clicks, clean)
    return listed, clean


def check_hour(spark, out, clicks, clean):
    """The last hour in panes of five seconds, by a plain loop."""
    pane = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) // 5
    newest = max(pane(r.event_time) for r in clicks.collect())
    want = {}
    for r in clean.collect():
        if newest - 720 < pane(r.event_time) <= newest:
            key = (r.date, r.event_time.hour, r.event_time.minute, r.ad_id)
            want[key] = want.get(key, 0) + 1
    columns = ("date", "hour", "minute", "ad_id", "click_count")
    assert {tuple(r)[:4]: r.click_count for r in out.trend_hour(spark).select(*columns).collect()} == want
    assert want


def test_pipeline(spark, landing, out):
    texts = make_lines()
    for i in range(0, len(texts), 150):
        landing.add(texts[i:i + 150])
    landing.add(["malformed", "1 2 3"])
    p.run_available(spark, stream(spark, landing), out, THRESHOLD)
    clicks = batch(spark, landing)
    assert clicks.count() == len(texts)
    listed, clean = check_against_batch(spark, out, clicks)
    assert sorted(tuples(clean)) == passed(spark, landing)
    sums = out.stat(spark).groupBy("province").agg(F.sum("click_count")).collect()
    assert sum(r[1] for r in sums) == clean.count()


def test_restart(spark, landing, out):
    texts = make_lines()
    landing.add(texts[:200])
    p.run_available(spark, stream(spark, landing), out, THRESHOLD)
    first_listed = {r.user_id for r in out.blacklist(spark).collect()}
    landing.add(texts[200:400])
    landing.add(texts[400:])
    p.run_available(spark, stream(spark, landing), out, THRESHOLD)
    listed, clean = check_against_batch(spark, out, batch(spark, landing))
    # users listed by the first run lose their later clicks; nobody is let through twice
    later = clean.where(F.col("event_time") >= F.lit(T + timedelta(seconds=2000)))
    final = {r.user_id for r in listed.collect()}
    assert first_listed <= final
    assert not final & {r.user_id for r in later.select("user_id").distinct().collect()}
    assert clean.count() <= len(texts)


def test_nothing_new_changes_nothing(spark, landing, out):
    landing.add(make_lines(100))
    for _ in range(2):
        p.run_available(spark, stream(spark, landing), out, THRESHOLD)
    assert tuples(out.user_click_count(spark)) == tuples(ads.user_daily_clicks(batch(spark, landing)))


def test_compaction_between_runs(spark, landing, out):
    texts = make_lines()
    landing.add(texts[:300])
    landing.add(texts[300:450])
    p.run_available(spark, stream(spark, landing), out, THRESHOLD)
    for table in (
        "ad_user_click_count", "ad_blacklist", "ad_stat", "ad_province_top3", "ad_click_trend"
    ):
        out.compact(spark, table, 0)
        out.compact(spark, table, 1)
    landing.add(texts[450:])
    p.run_available(spark, stream(spark, landing), out, THRESHOLD)
    check_against_batch(spark, out, batch(spark, landing))


def test_late_rows_leave_the_state(spark, landing, out):
    """With a watermark a click for a closed day is dropped, one for an open day counts."""
    def line(t, user):
        return f"{int((t - datetime(1970, 1, 1)).total_seconds() * 1000)} P C {user} 1"

    landing.add([line(T, 1), line(T, 2)])
    landing.add([line(T + timedelta(days=3), 1)])
    landing.add([line(T + timedelta(days=3), 7)])  # the watermark takes hold one batch later
    landing.add([line(T, 1), line(T + timedelta(days=2, hours=23), 5)])
    clicks = stream(spark, landing)
    p.run_available(spark, clicks, out, THRESHOLD, keep="1 day", steps=("gate",))
    got = {(r.date.day, r.user_id): r.click_count for r in out.user_click_count(spark).collect()}
    assert got == {(17, 1): 1, (17, 2): 1, (20, 1): 1, (20, 5): 1, (20, 7): 1}
    # the late one is stored, and so every click is somewhere
    assert [(r.date.day, r.user_id) for r in out.late(spark).collect()] == [(17, 1)]
    assert out.clean(spark).count() == 5


def test_totals_agree_under_a_watermark(spark, landing, out):
    texts = make_lines()
    order = texts[300:] + texts[:300]
    for i in range(0, 600, 150):
        landing.add(order[i:i + 150])
    for keep in ("1 hour",):
        p.run_available(spark, stream(spark, landing), out, 10**6, keep=keep)
        total = {
            t: f(spark).agg(F.sum("click_count")).first()[0]
            for t, f in (("stat", out.stat), ("trend", out.trend), ("users", out.user_click_count))
        }
        assert set(total.values()) == {600 - out.late(spark).count()}


def test_rejects_and_clocks_ahead(spark, landing, out):
    """A line of the year 3000 closes no day and is stored with the other rejects."""
    texts = make_lines(60)
    landing.add(["32503680000000 P C 1 1", "99999999999999999 P C 1 1", "short", texts[0] + " "])
    landing.add(texts[1:])
    lines = readers.read_text_stream(spark, str(landing.folder), 1)
    out.create(spark)
    p.start_rejects(lines, out, once=True).awaitTermination()
    clicks = ads.parse_ad_lines(lines, F.current_timestamp())
    p.run_available(spark, clicks, out, 10**6, keep="1 day")
    assert out.rejects(spark).count() == 3 and out.late(spark).count() == 0
    assert out.clean(spark).count() == 60
    assert out.stat(spark).agg(F.sum("click_count")).first()[0] == 60


def test_a_repeated_batch_changes_nothing(spark, landing, out):
    """The last batch of the gate is forgotten by its checkpoint and comes again."""
    texts = make_lines()
    for i in range(0, 600, 200):
        landing.add(texts[i:i + 200])
    p.run_available(spark, stream(spark, landing), out, THRESHOLD, steps=("gate",))
    before = tuples(out.clean(spark)), tuples(out.user_click_count(spark)), tuples(out.blacklist(spark))
    from pathlib import Path

    for f in Path(out.checkpoint("gate"), "commits").glob("*2*"):
        f.unlink()
    p.run_available(spark, stream(spark, landing), out, THRESHOLD, steps=("gate",))
    assert before == (tuples(out.clean(spark)), tuples(out.user_click_count(spark)), tuples(out.blacklist(spark)))
    assert sorted(before[0]) == passed(spark, landing)


def test_versions_and_listings_stay_flat(spark, landing, out, monkeypatch):
    """Small batches in a row: folding keeps the number of folders flat."""
    from pathlib import Path

    monkeypatch.setattr(p, "COMPACT_EVERY", 3)
    texts = make_lines(140)
    sizes = []
    for start in (0, 70):
        for i in range(start, start + 70, 10):
            landing.add(texts[i:i + 10])
        p.run_available(spark, stream(spark, landing), out, 10**6)
        tables_of = ("ad_user_click_count", "ad_stat", "ad_click_trend", "ad_province_top3")
        versions = {t: len(list(Path(out.path(t)).rglob("version=*"))) for t in tables_of}
        assert all(n <= 2 * (2 * 3 + 2) for n in versions.values()), versions
        sizes.append({f: len(list(Path(out.path(f)).iterdir())) for f in ("marks", "ad_hour_panes", "staging", "ad_late_clicks")})
        clean = [x.name for x in Path(out.path("clean")).iterdir()]
        assert sum(n.startswith("batch-") for n in clean) <= 2 * 3
        assert sum(n.startswith("upto-") for n in clean) <= 14 // 3
    assert sizes[0] == sizes[1] and max(sizes[1].values()) <= 2 * 2 * (len(p.STEPS) + 1)
    assert not Path(out.path("clicks")).exists() and not Path(out.path("newest")).exists()
    clean = out.clean(spark)
    assert tuples(out.stat(spark)) == tuples(ads.ad_stat(clean)) and clean.count() == 140
    assert sorted(tuples(clean)) == sorted(tuples(batch(spark, landing)))


def test_a_step_added_later_starts_from_all_clean_clicks(spark, landing, out):
    texts = make_lines()
    landing.add(texts[:300])
    p.run_available(spark, stream(spark, landing), out, THRESHOLD, steps=("gate",))
    assert out.trend(spark).count() == 0
    landing.add(texts[300:400])
    landing.add(texts[400:])
    p.run_available(spark, stream(spark, landing), out, THRESHOLD)
    check_against_batch(spark, out, batch(spark, landing))


def test_unknown_steps_are_refused(spark, landing, out):
    with pytest.raises(ValueError):
        p.run_available(spark, stream(spark, landing), out, steps=("gates",))


@pytest.mark.parametrize("broken", ["gate", "province_top", "trend_hour", "finish"])
def test_a_batch_that_failed_half_way_is_repeated(spark, landing, out, monkeypatch, broken):
    """A step writes and then fails: the batch comes again and nothing counts twice."""
    texts = make_lines(300)
    landing.add(texts[:150])
    landing.add(texts[150:])
    real, failed = getattr(p._Batch, broken), []

    def once(self, *args):
        real(self, *args)
        if self.id == 1 and not failed:
            failed.append(1)
            raise RuntimeError("lost")

    monkeypatch.setattr(p._Batch, broken, once)
    with pytest.raises(Exception):
        p.run_available(spark, stream(spark, landing), out, THRESHOLD)
    p.run_available(spark, stream(spark, landing), out, THRESHOLD)
    check_against_batch(spark, out, batch(spark, landing))


def test_continuous(spark, landing, out):
    """All queries at once on a short interval."""
    texts = make_lines(300)
    landing.add(texts[:200])
    queries = p.start_all(
        spark, stream(spark, landing), out, THRESHOLD, keep=None, interval="1 second"
    )
    try:
        landing.add(texts[200:])
        for q in queries * 2:
            q.processAllAvailable()
    finally:
        for q in queries:
            q.stop()
    check_against_batch(spark, out, batch(spark, landing))
