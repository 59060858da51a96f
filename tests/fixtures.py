"""Small hand-written tables."""

from datetime import date, datetime, timedelta

from clicktide.sources import schemas

T0 = datetime(2018, 12, 14, 6, 20, 0)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def action(session, seconds, user=1, page=1, keyword=None, category=None, product=None,
           order=None, pay=None, city=1):
    t = at(seconds)
    return (t.date(), user, session, page, t, keyword, category, product, order, order, pay, pay, city)


def actions(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ACTIONS)


def users(spark, *rows):
    """Rows of (user_id, age, professional, city, sex)."""
    full = [(u, f"u{u}", f"n{u}", age, prof, city, sex) for u, age, prof, city, sex in rows]
    return spark.createDataFrame(full, schemas.USER_INFO)


def cities(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.CITY_INFO)


def products(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PRODUCT_INFO)


def clicks(spark, *rows):
    """Rows of (event_time, province, city, user_id, ad_id)."""
    full = [(t, t.date(), p, c, u, a) for t, p, c, u, a in rows]
    return spark.createDataFrame(full, schemas.AD_CLICKS)


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def day(n: int) -> date:
    return date(2018, 12, n)
