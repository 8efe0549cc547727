import math

import pytest
from pyspark.sql import functions as F

from tidegauge import registry
from tidegauge.query import parser, planner
from tidegauge.query.evaluate import Evaluator, points


@pytest.mark.parametrize("text", ['sum by (job) (rate(x_total{a="b"}[5m] offset 1h)) / 2', "a / on(x) group_left(y) b", "max_over_time(rate(x[1m])[5m:30s])", 'm{a!~"x|y\\"z"} @ end()', "-(a ^ -2) unless ignoring(q) b", "topk without (a) (3, b) > bool 2"])
def test_text_of_a_tree_is_the_same_tree(text):
    assert parser.parse(planner.text_of(parser.parse(text))) == parser.parse(text)


@pytest.mark.parametrize("text", ["", "a b", "sum(", "x[5]", "rate(x[5m]", '{a=""}', "1 +", "a == bool", "x offset", "a + bool b", "'open"])
def test_what_is_no_expression_is_refused(text):
    with pytest.raises(ValueError):
        parser.parse(text)


def test_operators_bind_as_usual():
    assert parser.parse("1 + 2 * 3 ^ 2 ^ 0.5") == parser.parse("1 + (2 * (3 ^ (2 ^ 0.5)))")
    assert parser.parse("-2 ^ 2") == parser.parse("-(2 ^ 2)")
    assert parser.parse("a or b and c == d") == parser.parse("a or (b and (c == d))")


@pytest.mark.parametrize(
    ("text", "kind"),
    [("up", "sample_mean"), ("rate(x[5m])", "time_mean"), ("sum by (a) (rate(x[5m])) * 60", "time_mean"), ("increase(x[1m])", "sum"), ("increase(x[5m])", "time_mean"), ("max_over_time(x[1m])", "max"), ("a / b", "ratio"), ("histogram_quantile(0.9, h_bucket)", "quantile"), ("a + b", "unknown")],
)
def test_merge_kind(text, kind):
    assert planner.merge_kind(text, 60_000, 60_000) == kind


def test_quantiles_are_outermost():
    assert planner.quantile_of(parser.parse("histogram_quantile(0.95, x)")) == 0.95
    for text in ("avg(histogram_quantile(0.95, x))", "quantile(0.9, x)", "histogram_quantile(0.9, x) * 2"):
        with pytest.raises(ValueError):
            planner.quantile_of(parser.parse(text))


def test_what_merges():
    assert planner.merge_problem("sum", "sum_over_time") is None and planner.merge_problem("mean", "avg") and planner.merge_problem("percentile", "max")
    assert planner.merge_problems("avg(p99) + sum(n)", {"p99": "percentile", "n": "count"}) == ["avg(p99): " + planner.merge_problem("percentile", "avg")]
    assert planner.time_op_problem("filter", "distribution") and planner.time_op_problem("spectrum", "gauge") is None
    with pytest.raises(ValueError):
        planner.merge_problem("mood", "sum")


def test_observations_and_rewrites():
    text = lambda q, step=60_000: planner.text_of(planner.observations(parser.parse(q), step))
    assert text("sum by (a) (x)") == "sum by (a) (count_over_time(x[1m]))"
    assert text('histogram_quantile(0.9, sum by (le) (rate(h_bucket{a="b"}[5m])))') == 'increase(h_count{a="b"}[1m])'
    assert planner.bucket_queries("up offset 5m", 60_000, 15_000)["max"] == "max_over_time(up[1m] offset 5m)"
    assert planner.bucket_queries("a + b", 60_000, 15_000)["count"] == "count_over_time(((a) + (b))[1m:15s])"
    assert planner.expand("rate(x[$__rate_interval])", 60_000, 15_000) == "rate(x[1m15s])"
    assert planner.counter_source(parser.parse("sum(rate(x[5m])) * 60")) == parser.parse("x") and planner.looks_like_histogram(parser.parse("sum by (le) (x)"))


def _points(spark, rows):
    return spark.createDataFrame(rows, "labels string, ts_ms long, value double")


def test_duplicates_fail_only_where_they_meet(spark):
    rows = [('{"__name__":"a","i":"1","k":"x"}', 0, 1.0), ('{"__name__":"a","i":"1","k":"y"}', 0, 2.0), ('{"__name__":"b","i":"2"}', 0, 3.0)]
    run = lambda q: {(r["labels"], r["value"]) for r in Evaluator(_points(spark, rows)).instant(q, 0).collect()}
    assert run("a + on(i) b") == set()
    with pytest.raises(Exception, match="many-to-many"):
        run("a + on(i) a")
    with pytest.raises(Exception, match="same labels"):
        run('{__name__=~"a|b"} and on() vector(1) or label_replace(a, "k", "z", "", "")')
    assert run('count by (k) ({__name__=~"a|b"})') == {('{"k":"x"}', 1.0), ('{"k":"y"}', 1.0), ("{}", 1.0)}


def test_nan_and_infinity(spark):
    rows = [('{"__name__":"a","i":"n"}', 0, math.nan), ('{"__name__":"a","i":"1"}', 0, 1.0), ('{"__name__":"a","i":"2"}', 0, -2.0)]
    run = lambda q: {r["labels"][-4:-2]: r["value"] for r in Evaluator(_points(spark, rows)).instant(q, 0).collect()}
    assert set(run("a == a")) == {'"1', '"2'} and set(run("a != 1")) == {'"n', '"2'}
    assert [r["value"] for r in Evaluator(_points(spark, rows)).instant("sort_desc(a)", 0).collect()][:2] == [1.0, -2.0]
    assert run("a / 0")['"2'] == -math.inf and math.isnan(run("sqrt(a)")['"2']) and run("bottomk(1, a)") == {'"2': -2.0}


def test_limits_refuse(spark):
    with pytest.raises(ValueError):
        Evaluator(_points(spark, [])).range("a", 0, 11_000, 1)


def test_label_values(spark):
    rows = [('{"__name__":"a","i":"1"}', 0, 1.0), ('{"__name__":"a","i":"2"}', 9, 1.0), ('{"__name__":"b","i":"3"}', 0, 1.0)]
    e = Evaluator(_points(spark, rows))
    assert [r["value"] for r in e.label_values("i", parser.parse("a").matchers, 10).collect()] == ["1", "2"]
    assert [r["value"] for r in e.label_values("i", parser.parse('{i=~".+"}').matchers, 10, end=5).collect()] == ["1", "3"]


def test_an_expression_reads_the_metrics_it_names_alone(spark):
    """A metric that fails when it is read does no harm to an expression without its name; a pattern reads all."""
    rows = spark.createDataFrame([("a", 1_000, 1.0), ("b", 2_000, 2.0)], "job string, ts_ms long, value double")
    broken = rows.withColumn("value", F.raise_error(F.lit("read")).cast("double"))
    by_name = Evaluator({"good": points(rows, "good", ["job"]), "bad": points(broken, "bad", ["job"])})
    total = lambda text: [(r["labels"], r["value"]) for r in by_name.range(text, 60_000, 60_000, 60_000).collect()]
    assert total("sum(good) / scalar(count(good))") == [("{}", 1.5)] and total('sum(good{job="b"})') == [("{}", 2.0)]
    with pytest.raises(Exception, match="read"):
        total('sum({__name__=~"good|bad"})')
    plan = registry.queries()["expr_group_left"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "row_number" not in plan
