"""Queries over the catalogue and over text sources, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import catalog
from tidegauge.plans.catalogue import CL, claim_rows, rounded
from tidegauge.plans.shapes import special, values
from tidegauge.registry import register
from tidegauge.sources import events as src
from tidegauge.sources import text

# --- names made from events: app_<type>_shard<n>_<unit> ---
NM = "NM AS (SELECT DISTINCT 'app_' || event_type || '_shard' || (user_id % 60) || '_' || ['seconds', 'bytes', 'total'][CAST(event_id % 3 + 1 AS INT)] AS name FROM events)"


def names(s: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit("seconds"), F.lit("bytes"), F.lit("total")), (F.col("event_id") % 3 + 1).cast("int"))
    made = F.concat(F.lit("app_"), F.col("event_type"), F.lit("_shard"), (F.col("user_id") % 60).cast("string"), F.lit("_"), unit)
    return src.table(s, d, "events").select(made.alias("name")).distinct().withColumn("type", F.lit("unknown")).withColumn("help", F.lit(None).cast("string"))


_FAM = "FA AS (SELECT name, i, list_aggregate(list_transform(string_split(name, '_'), lambda w, j: CASE WHEN j = i THEN '*' ELSE w END), 'string_agg', '_') AS family, string_split(name, '_')[i] AS word FROM NM, (SELECT unnest([1, 2, 3, 4]) AS i)), LA AS (SELECT family, count(DISTINCT word) AS n FROM FA GROUP BY ALL HAVING count(DISTINCT word) >= 20), FB AS (SELECT name, family, word, row_number() OVER (PARTITION BY name ORDER BY n DESC, i DESC, family DESC) AS k FROM FA JOIN LA USING (family)), FF AS (SELECT name, family, word FROM FB WHERE k = 1)"
register("name_families", f"WITH {NM}, {_FAM} SELECT name, family, word FROM FF")(lambda s, d: catalog.families(names(s, d)))
register("name_families_quality", f"WITH {NM}, {_FAM}, Q AS (SELECT name, regexp_replace(name, '_shard[0-9]+_', '_*_') AS wanted FROM NM) SELECT round(count(family) / nullif(count(family), 0), 7) AS precision, round(count(family) / count(*), 7) AS recall, round(count(*) FILTER (family = wanted) / nullif(count(family), 0), 7) AS agreement FROM Q LEFT JOIN FF USING (name)")(
    lambda s, d: rounded(catalog.evaluate_families(catalog.families(names(s, d)), names(s, d).select("name", F.regexp_replace("name", "_shard[0-9]+_", "_*_").alias("family"))), "precision", "recall", "agreement")
)
register("catalog_search", f"WITH {NM}, H AS (SELECT name, CASE WHEN name LIKE '%\\_click\\_%' ESCAPE '\\' THEN 3 WHEN name LIKE '%\\_view\\_%' ESCAPE '\\' THEN 2 ELSE 0 END AS a, CASE WHEN name LIKE '%seconds' THEN 3 ELSE 0 END AS b FROM NM) SELECT name, CAST(a + b + 1.5 AS DOUBLE) AS score, CAST(1 + (a > 0)::INT + (b > 0)::INT AS BIGINT) AS matched FROM H WHERE 2 * (1 + (a > 0)::INT + (b > 0)::INT) >= 3")(
    lambda s, d: catalog.search(names(s, d), values(s, "('click'), ('second'), ('shard')", "term"), values(s, "('click', 'view')", "term, word"))
)
register("catalog_rules", f"WITH {NM} SELECT name AS metric, CASE WHEN name LIKE '%total' THEN 'kind' ELSE 'unit' END AS field, 'rule' AS origin, CASE WHEN name LIKE '%total' THEN 'counter' WHEN name LIKE '%seconds' THEN 's' ELSE 'bytes' END AS value FROM NM")(lambda s, d: catalog.rule_claims(names(s, d)))
_CM = f"{CL}, CM AS (SELECT 'm_' || metric AS name, field, origin, strength, value, confidence, ts_ms FROM CL), ME AS (SELECT DISTINCT name FROM CM)"


def user_claims(s: SparkSession, d: str) -> DataFrame:
    return claim_rows(s, d).withColumn("metric", F.concat(F.lit("m_"), F.col("metric").cast("string")))


def user_metrics(s: SparkSession, d: str) -> DataFrame:
    return user_claims(s, d).select(F.col("metric").alias("name")).distinct().withColumn("type", F.lit("gauge"))


register(
    "catalog_browse",
    f"WITH {_CM}, WI AS (SELECT name, field, confidence FROM CM QUALIFY row_number() OVER (PARTITION BY name, field ORDER BY strength, confidence DESC, ts_ms DESC, value DESC) = 1), BE AS (SELECT name, count(*) AS fields, min(confidence) AS weakest FROM WI GROUP BY ALL), CO AS (SELECT name, count(*) AS conflicts FROM (SELECT name, field FROM CM GROUP BY ALL HAVING count(DISTINCT value) > 1) GROUP BY ALL) SELECT name, 'gauge' AS type, coalesce(fields, 0) AS fields, round(weakest, 7) AS weakest, coalesce(conflicts, 0) AS conflicts FROM ME LEFT JOIN BE USING (name) LEFT JOIN CO USING (name) WHERE name LIKE 'm\\_1%' ESCAPE '\\' ORDER BY conflicts DESC, name LIMIT 5 OFFSET 5",
)(lambda s, d: rounded(catalog.browse(user_metrics(s, d), user_claims(s, d), r"m\_1%", "click", "conflicts", 5, 1), "weakest"))
register("catalog_overview", f"WITH {_CM}, R AS (SELECT DISTINCT name FROM CM WHERE origin = 'user') SELECT 'm' AS family, count(*) AS metrics, count(R.name) AS reviewed FROM ME LEFT JOIN R USING (name)")(lambda s, d: catalog.overview(user_metrics(s, d), user_claims(s, d)))
register("relearn_diff", f"WITH {NM} SELECT name, CASE WHEN name LIKE '%shard1\\_%' ESCAPE '\\' THEN 'new' WHEN name LIKE '%shard2\\_%' ESCAPE '\\' THEN 'removed' ELSE 'returned' END AS change FROM NM WHERE regexp_matches(name, 'shard[123]_')")(
    lambda s, d: catalog.relearn(names(s, d).filter("name NOT LIKE '%shard1\\_%'").select("name", F.col("name").rlike("shard3_").alias("gone")), names(s, d).filter("name NOT LIKE '%shard2\\_%'"))
)
register("put_claims", f"""WITH {CL}, O AS (SELECT metric, field, origin, max_by(value, (ts_ms, value)) AS value, max_by(confidence, (ts_ms, value)) AS confidence, max(ts_ms) AS ts_ms FROM CL WHERE metric < 25 GROUP BY ALL),
N AS (SELECT metric, field, origin, max_by(value, (ts_ms, value)) AS value, max_by(confidence, (ts_ms, value)) AS confidence, max(ts_ms) AS ts_ms FROM CL WHERE metric >= 20 GROUP BY ALL)
SELECT metric, field, origin, value, round(confidence, 7) AS confidence, ts_ms FROM N UNION ALL SELECT metric, field, origin, value, round(confidence, 7), ts_ms FROM O WHERE metric < 20""")(
    lambda s, d: rounded(catalog.put_claims(catalog.put_claims(claim_rows(s, d).limit(0), claim_rows(s, d).filter("metric < 25")), claim_rows(s, d).filter("metric >= 20")), "confidence")
)
_ED = "('b', 'a', 'same', 0.5, 1), ('a', 'b', 'same', 0.9, 0), ('a', 'b', 'part', 0.1, 1), ('b', 'a', 'part', 0.2, 1), ('c', 'c', 'same', 1.0, 1)"
register("catalog_relations", "SELECT * FROM (VALUES ('a', 'b', 'same', 0.9::DOUBLE, 0), ('a', 'b', 'part', 0.1, 1), ('b', 'a', 'part', 0.2, 1)) v(a, b, kind, confidence, ts_ms)")(lambda s, d: catalog.relations(values(s, _ED, "a, b, kind, confidence, ts_ms").withColumn("confidence", F.col("confidence").cast("double")), ("same",)))
_PK = "('m_.*', TRUE, 'owner', 'infra'), ('m_1', FALSE, 'owner', 'web'), ('m_1.', TRUE, 'owner', 'data')"
register("catalog_packs", f"WITH {_CM} SELECT name AS metric, 'owner' AS field, 'pack' AS origin, CASE WHEN name = 'm_1' THEN 'web' ELSE 'infra' END AS value FROM ME")(lambda s, d: catalog.pack_claims(user_metrics(s, d), values(s, _PK, "pattern, is_regex, field, value").filter("value <> 'data'")))
_RO = "('http_requests_total', 'counter'), ('http_request_errors_total', 'counter'), ('request_latency', 'gauge'), ('queue_pending', 'gauge'), ('noise', 'gauge')"
register("role_candidates", "SELECT * FROM (VALUES ('rate', 1, 'http_request_errors_total'), ('rate', 2, 'http_requests_total'), ('rate', 3, 'request_latency'), ('errors', 1, 'http_request_errors_total'), ('duration', 1, 'request_latency'), ('saturation', 1, 'queue_pending')) v(role, place, name)")(
    lambda s, d: catalog.role_candidates(values(s, "('http_request_errors_total', 'counter'), ('http_requests_total', 'gauge'), ('request_latency', 'gauge'), ('queue_pending', 'gauge'), ('noise', 'gauge')", "name, type")).filter("role <> 'x'").filter("NOT (role = 'rate' AND place > 3)")
)
_TK = "('httpRequestLatencies_bytes.total'), ('process__cpu-Seconds'), ('status class'), ('')"
register("name_tokens", "SELECT * FROM (VALUES ('httpRequestLatencies_bytes.total', 'http request latency byte total'), ('process__cpu-Seconds', 'process cpu second'), ('status class', 'statu class'), ('', '')) v(name, tokens)")(
    lambda s, d: values(s, _TK, "name").withColumn("tokens", F.array_join(catalog.tokens(F.col("name")), " "))
)
_SRC = """('a.py', 'x = Counter("jobs_total", "Jobs done")\ny=Gauge(''temp'', ''Heat'')'), ('b.go', 'prometheus.NewHistogramVec(prometheus.HistogramOpts{Name: "lat", Help: "Wait"}, l)'), ('c.md', 'Counter of things')"""
_DEF = "('a.py', 'jobs_total', 'counter', 'Jobs done'), ('a.py', 'temp', 'gauge', 'Heat'), ('b.go', 'lat', 'histogram', 'Wait')"


def sources(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("a.py", 'x = Counter("jobs_total", "Jobs done")\ny=Gauge(\'temp\', \'Heat\')'), ("b.go", 'prometheus.NewHistogramVec(prometheus.HistogramOpts{Name: "lat", Help: "Wait"}, l)'), ("c.md", "Counter of things")], "path string, text string")


register("context_definitions", f"SELECT * FROM (VALUES {_DEF}) v(path, name, kind, help)")(lambda s, d: catalog.definitions(sources(s)))
register("context_claims", "SELECT * FROM (VALUES ('jobs_total', 'kind', 'counter'), ('jobs_total', 'help', 'Jobs done'), ('lat_bucket', 'kind', 'histogram'), ('lat_bucket', 'help', 'Wait')) v(metric, field, value)")(
    lambda s, d: catalog.context_claims(values(s, "('jobs_total'), ('lat_bucket'), ('other')", "name"), catalog.definitions(sources(s)))
)

# --- exposition text ---
_LINES = ["# HELP up Is it there", "# TYPE up gauge", 'up{job="a",inst="x\\"y"} 1 1700000000000', "up 0", "  ", 'lat_bucket{le="+Inf", } +Inf 5', "# TYPE lat histogram", "# odd", "x -inf 7"]


def lines(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(x,) for x in _LINES], "value string")


register("exposition", """SELECT * FROM (VALUES ('{"__name__":"up","inst":"x\\"y","job":"a"}', 1700000000000, '1.0'), ('{"__name__":"up"}', 9, '0.0'), ('{"__name__":"lat_bucket","le":"+Inf"}', 5, '+Inf'), ('{"__name__":"x"}', 7, '-Inf')) v(labels, ts_ms, value)""")(
    lambda s, d: text.exposition(lines(s), 9).selectExpr("labels", "ts_ms", f"{special('value')} AS value")
)
register("exposition_metadata", "SELECT * FROM (VALUES ('up', 'gauge', 'Is it there', ''), ('lat', 'histogram', '', '')) v(name, type, help, unit)")(lambda s, d: text.metadata(lines(s)))
register("inline_series", "SELECT * FROM (VALUES ('a', 0, 1.0::DOUBLE), ('a', 30, NULL), ('b', 45, 2.5)) v(label, ts_ms, value)")(lambda s, d: text.inline(s, [{"label": "a", "ts": [0, 30], "values": [1, None]}, {"label": "b", "ts": [45], "values": [2.5]}])[0])
register("table_matrix", "SELECT * FROM (VALUES (0, 'x', 1.0::DOUBLE), (0, 'y', 2.0), (1, 'x', NULL), (1, 'y', 4.0)) v(row, \"column\", value)")(lambda s, d: text.matrix(s, ["x", "y"], [[1, 2], [None, 4]]))
