import pytest

from tidegauge.sources import esquery


@pytest.mark.parametrize("body", [{"size": 1}, {"metric": {}}, {"metric": {"sum": {}}}, {"metric": {"sum": {"field": "v"}, "avg": {"field": "v"}}}, {"metric": {"percentiles": {"field": "v"}}}, {"metric": {"percentiles": {"field": "v", "percent": 100}}}, {"metric": {"mode": {"field": "v"}}}])
def test_bodies_that_are_refused(body):
    with pytest.raises(ValueError):
        esquery.parse(body)


def test_fields_and_groups_are_checked(spark):
    docs = spark.range(600).selectExpr("id AS ts_ms", "CAST(id AS STRING) AS name", "1.0D AS v")
    for body in ({"metric": {"sum": {"field": "name"}}}, {"group": ["nope"]}, {"group": ["name"]}):
        with pytest.raises(ValueError):
            esquery.fetch(docs, body, 1000)
    assert esquery.fetch(docs, {"metric": {"avg": {"field": "v"}}}, 1000).collect()[0]["count"] == 600
    assert esquery.discover(docs) == [("ts_ms", "metric"), ("name", "label"), ("v", "metric")]
