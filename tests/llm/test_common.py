import pytest

from pyspark.sql import functions as F

from tripwire.llm import common


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_among_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_KEYS", limit)
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"), F.lit("wide").alias("key")).union(spark.sql("select 9999, null, 'x'"))
    keys = common.written(rows.filter("id % 7 = 0").select("h").union(spark.sql("select -5L")), "keys")
    got = common.among(rows, "h", keys)
    assert got.columns == rows.columns
    assert sorted(r["id"] for r in got.collect()) == list(range(0, 3000, 7))
    assert common.among(rows, "h", keys.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_parted_loses_no_row(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_KEYS", limit)
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h")).union(spark.sql("select 9999, null"))
    keys = common.written(rows.filter("id % 100 = 0").select("h").union(rows.filter("id = 0").select("h")), "keys")
    maybe, never = common.parted(rows, "h", keys)
    a, b = ({r["id"] for r in x.collect()} for x in (maybe, never))
    assert a | b == {*range(3000), 9999} and not a & b and maybe.count() + never.count() == 3001
    assert a >= set(range(0, 3000, 100)) and len(a) < 600 and 9999 in b


def test_scopes_delete_their_tables(spark):
    def there(df):
        try:
            return df.count() == 5
        except Exception:
            return False

    with common.temporary(spark):
        with common.temporary(spark):
            gone, moved = common.written(spark.range(5), "a"), common.written(spark.range(5), "b", keep=True)
        assert not there(gone) and there(moved)
        stays = common.written(spark.range(5), "c", keep=True)
    assert not there(moved) and there(stays)
