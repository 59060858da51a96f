"""The bitmap lets every listed id through to the exact look-up, whatever else it lets through."""

from clicktide.operators import ads, bitmap
from clicktide.sources import schemas, tables


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "user_id bigint")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_listed_ids_pass_and_few_others(spark):
    listed, others = range(0, 3000), range(10_000, 30_000)
    bits = bitmap.marked(frame(spark, listed))
    assert ids(bitmap.maybe_in(frame(spark, listed), bits)) == list(listed)
    assert len(ids(bitmap.maybe_in(frame(spark, others), bits))) < 40
    assert bits.selectExpr("sum(octet_length(bits))").first()[0] <= bitmap.SIZE // 8


def test_joined_is_the_bitmap_of_both(spark):
    one, two = bitmap.marked(frame(spark, [1, 2])), bitmap.marked(frame(spark, [2, 3, 70_000]))
    both = bitmap.joined(one, two)
    assert ids(bitmap.maybe_in(frame(spark, [1, 2, 3, 4, 70_000]), both)) == [1, 2, 3, 70_000]
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, bitmap.marked(frame(spark, [1, 2, 3, 70_000])).collect()))


def test_forced_collisions_drop_nobody_by_mistake(spark, tmp_path):
    """A bitmap of eight bits marks nearly everyone; the exact look-up behind it decides."""
    listed, users = [3, 5, 8, 13, 21, 34], list(range(60))
    path = tables.ensure_table(spark, str(tmp_path / "listed"))
    tables.insert_absent(frame(spark, listed), path, schemas.AD_BLACKLIST, ["user_id"], 0)
    maybe = bitmap.maybe_in(frame(spark, users), bitmap.marked(frame(spark, listed), size=8), size=8)
    assert len(ids(maybe)) > len(listed)
    keyed = maybe.withColumn(tables.BUCKET, tables.bucket_of(["user_id"]))
    stored = tables.stored_in_buckets(spark, path, schemas.AD_BLACKLIST, tables.touched_buckets(keyed))
    kept = ads.drop_listed(frame(spark, users), stored.join(keyed, ["user_id", tables.BUCKET], "left_semi"))
    assert ids(kept) == [u for u in users if u not in listed]


def test_empty_list(spark):
    assert ids(bitmap.maybe_in(frame(spark, [1]), bitmap.marked(frame(spark, [])))) == []
