"""The catalogue of metrics as tables: metrics(name, type, help), claims(metric, field, origin, value, confidence, ts_ms).

Names are mined, searched and paged by set operations; rules and packs are small tables that the names are joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.claims import winners

#: Distinct words that a place of a name must take for its names to be a family.
MIN_SUPPORT = 20
#: Rows of a rule, pack or synonym table, which is broadcast.
MAX_RULES = 10_000
# Endings of names that tell a unit or a kind.
UNIT_ENDINGS = {"seconds": "s", "milliseconds": "ms", "bytes": "bytes", "ratio": "1", "percent": "%", "celsius": "celsius", "volts": "V", "amperes": "A", "joules": "J", "meters": "m", "grams": "g"}
KIND_ENDINGS = {"total": "counter", "count": "counter", "sum": "counter", "bucket": "histogram", "info": "info", "created": "timestamp"}
# Words of a name that tell which role it may play.
ROLE_WORDS = {"rate": ("requests", "request", "calls", "queries", "messages", "events"), "errors": ("errors", "error", "failures", "failed", "exceptions"), "duration": ("duration", "latency", "seconds"), "utilisation": ("usage", "utilisation", "utilization", "busy"), "saturation": ("queue", "pending", "waiting", "backlog")}


def tokens(text: Column) -> Column:
    """Words of a name or a help text: cut at camelCase and at all but letters and digits, lower case, singular."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")
    n = F.char_length
    return F.transform(words, lambda w: F.when((n(w) > 4) & w.endswith("ies"), F.concat(w.substr(F.lit(1), n(w) - 3), F.lit("y"))).when((n(w) > 3) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), n(w) - 1)).otherwise(w))


def _small(table: DataFrame, what: str) -> DataFrame:
    n = table.limit(MAX_RULES + 1).count()
    if n > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} {what}")
    return F.broadcast(table)


def search(metrics: DataFrame, query: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, score, matched) of metrics that meet at least half of the query's words: 3 for a word of the name, 2 for a
    synonym of it, 1.5 for a word it begins, 1 for a word of the help; the best of these a word. query(term),
    synonyms(term, word)."""
    asked = query.distinct()
    wanted = asked.select("term", F.col("term").alias("word"), F.lit(3.0).alias("worth")).unionByName(asked.join(synonyms, "term").select("term", "word", F.lit(2.0).alias("worth")))
    own = metrics.select("name", F.explode(F.array_distinct(tokens(F.col("name")))).alias("word"))
    helped = metrics.select("name", F.explode(F.array_distinct(tokens(F.coalesce("help", F.lit(""))))).alias("word"))
    wanted = _small(wanted, "query words")
    hits = own.join(wanted, "word").select("name", "term", "worth")
    begun = own.join(_small(asked, "query words"), (F.col("word") != F.col("term")) & F.col("word").startswith(F.col("term"))).select("name", "term", F.lit(1.5).alias("worth"))
    told = helped.join(wanted.filter("worth = 3"), "word").select("name", "term", F.lit(1.0).alias("worth"))
    best = hits.unionByName(begun).unionByName(told).groupBy("name", "term").agg(F.max("worth").alias("worth"))
    n = asked.count()
    return best.groupBy("name").agg(F.sum("worth").alias("score"), F.count("*").alias("matched")).filter(F.col("matched") * 2 >= n)


def browse(metrics: DataFrame, claims: DataFrame, like: str | None = None, has_field: str | None = None, order: str = "name", size: int = 50, number: int = 0) -> DataFrame:
    """A page of the catalogue: name, type, fields claimed, weakest confidence of what wins, conflicts. order: name, weakest
    or conflicts. like is a pattern with % and _, where a backslash takes their meaning."""
    if not 1 <= size <= 100 or order not in ("name", "weakest", "conflicts"):
        raise ValueError("a page has 1 to 100 rows, ordered by name, weakest or conflicts")
    rows = metrics if like is None else metrics.filter(F.col("name").like(like))
    if has_field is not None:
        rows = rows.join(claims.filter(F.col("field") == has_field).select(F.col("metric").alias("name")), "name", "left_semi")
    best = winners(claims).groupBy(F.col("metric").alias("name")).agg(F.count("*").alias("fields"), F.min("confidence").alias("weakest"))
    torn = claims.groupBy(F.col("metric").alias("name"), "field").agg(F.count_distinct("value").alias("v")).filter("v > 1").groupBy("name").agg(F.count("*").alias("conflicts"))
    found = rows.join(best, "name", "left").join(torn, "name", "left").select("name", "type", F.coalesce("fields", F.lit(0)).alias("fields"), "weakest", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))
    by = {"name": ["name"], "weakest": [F.coalesce("weakest", F.lit(-1.0)), "name"], "conflicts": [F.desc("conflicts"), "name"]}[order]
    return found.orderBy(*by).offset(size * number).limit(size)


def overview(metrics: DataFrame, claims: DataFrame) -> DataFrame:
    """Names by their first word, with how many of them a user has reviewed; the least reviewed first."""
    reviewed = claims.filter("origin = 'user'").select(F.col("metric").alias("name")).distinct().withColumn("r", F.lit(1))
    return metrics.join(reviewed, "name", "left").groupBy(F.split("name", "_")[0].alias("family")).agg(F.count("*").alias("metrics"), F.count("r").alias("reviewed")).orderBy(F.col("reviewed") / F.col("metrics"), F.desc("metrics"), "family")


def families(names: DataFrame, support: int = MIN_SUPPORT) -> DataFrame:
    """(name, family, word) of names that are alike but for one word: a family is a name with * in one place, which takes
    at least support words; a name joins its family of most words, then the one with the later place, then by text.
    Each name is dealt to as many candidates as it has words; nothing is compared pairwise."""
    words = F.split("name", "_")
    at = F.explode(F.sequence(F.lit(0), F.size(words) - 1))
    dealt = names.select("name").distinct().withColumn("i", at)
    template = F.concat_ws("_", F.slice(words, F.lit(1), F.col("i")), F.lit("*"), F.slice(words, F.col("i") + 2, F.size(words)))
    dealt = dealt.select("name", "i", template.alias("family"), F.get(words, F.col("i")).alias("word"))
    # Within a family of one place, each name has a word of its own: the rows are the support.
    large = dealt.groupBy("family").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    best = dealt.join(large, "family").groupBy("name").agg(F.max(F.struct("n", "i", "family", "word")).alias("b"))
    return best.select("name", "b.family", "b.word")


def evaluate_families(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """Precision and recall of being in a family, and how often the family is the labelled one, over labelled(name, family)."""
    both = labelled.withColumnRenamed("family", "wanted").join(found, "name", "left")
    hit = F.count_if(F.col("family").isNotNull() & F.col("wanted").isNotNull())
    return both.agg(F.try_divide(hit, F.count("family")).alias("precision"), F.try_divide(hit, F.count("wanted")).alias("recall"), F.try_divide(F.count_if(F.col("family") == F.col("wanted")), hit).alias("agreement"))


def rule_claims(metrics: DataFrame) -> DataFrame:
    """Claims of the lowest origin, from how names end and from the stated type: (metric, field, origin, value)."""
    last = F.regexp_extract("name", "([a-z]+)$", 1)
    stem = F.regexp_replace("name", "_(total|count|sum|bucket)$", "")
    table = lambda d: F.create_map(*[F.lit(x) for k in d for x in (k, d[k])])
    unit = F.try_element_at(table(UNIT_ENDINGS), F.regexp_extract(stem, "([a-z]+)$", 1))
    kind = F.coalesce(F.when(F.col("type").isin("counter", "gauge", "histogram", "summary"), F.col("type")), F.try_element_at(table(KIND_ENDINGS), last))
    origin = F.when(F.col("type").isin("counter", "gauge", "histogram", "summary"), "metadata").otherwise("rule")
    made = F.array(F.struct(F.lit("unit").alias("field"), F.lit("rule").alias("origin"), unit.alias("value")), F.struct(F.lit("kind").alias("field"), origin.alias("origin"), kind.alias("value")))
    return metrics.select(F.col("name").alias("metric"), F.explode(made).alias("c")).select("metric", "c.*").filter("value IS NOT NULL")


def pack_claims(metrics: DataFrame, pack: DataFrame) -> DataFrame:
    """Claims of a knowledge pack(pattern, is_regex, field, value): an exact entry beats a pattern, then the longer pattern."""
    pack = _small(pack, "pack entries")
    exact = metrics.join(pack.filter("NOT is_regex"), F.col("name") == F.col("pattern")).withColumn("rank", F.lit(1 << 20))
    matched = metrics.join(pack.filter("is_regex"), F.expr("name RLIKE concat('^(?:', pattern, ')$')")).withColumn("rank", F.char_length("pattern"))
    both = exact.unionByName(matched)
    return both.groupBy(F.col("name").alias("metric"), "field").agg(F.max(F.struct("rank", "pattern", "value")).alias("b")).select("metric", "field", F.lit("pack").alias("origin"), "b.value")


def relearn(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change) between old(name, gone) and new(name): new, removed or returned; what stays has no row."""
    both = old.select("name", "gone").withColumn("was", F.lit(True)).join(new.select("name").distinct().withColumn("is", F.lit(True)), "name", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull() & ~F.col("gone"), "removed").when(F.col("is").isNotNull() & F.col("gone"), "returned")
    return both.select("name", change.alias("change")).filter("change IS NOT NULL")


def put_claims(stored: DataFrame, given: DataFrame) -> DataFrame:
    """stored with given upserted by (metric, field, origin); a claim with the same value and confidence keeps its time. Of
    several given ones the last by time counts."""
    keys = ["metric", "field", "origin"]
    rest = [c for c in stored.columns if c not in keys]
    newest = given.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts_ms", "value")).alias("g"))
    both = stored.select(*keys, F.struct(*rest).alias("s")).join(newest, keys, "full")
    same = F.col("s").isNotNull() & F.col("s.value").eqNullSafe(F.col("g.value")) & F.col("s.confidence").eqNullSafe(F.col("g.confidence"))
    pick = F.when(F.col("g").isNull() | same, F.col("s")).otherwise(F.col("g"))
    return both.withColumn("p", pick).select(*[c if c in keys else F.col(f"p.{c}").alias(c) for c in stored.columns])


def relations(edges: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    """One edge (a, b, kind) of each: symmetric kinds hold their ends in order, none joins a metric with itself; of equal
    ones the surest, then the newest."""
    ordered = F.col("kind").isin(*symmetric)
    a, b = F.when(ordered, F.least("a", "b")).otherwise(F.col("a")), F.when(ordered, F.greatest("a", "b")).otherwise(F.col("b"))
    rows = edges.filter("a <> b").select(a.alias("a"), b.alias("b"), "kind", "confidence", "ts_ms")
    return rows.groupBy("a", "b", "kind").agg(F.max(F.struct("confidence", "ts_ms")).alias("x")).select("a", "b", "kind", "x.*")


def role_candidates(metrics: DataFrame, best: int = 3) -> DataFrame:
    """The best names for each role, by how many of their words tell it, counters first for rates and errors."""
    has = F.array_distinct(F.concat(tokens(F.col("name")), F.split("name", "_")))
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.size(F.array_intersect(has, F.array(*map(F.lit, words)))).alias("hits")) for role, words in ROLE_WORDS.items()])
    fits = ((F.col("type") == "counter") & F.col("r.role").isin("rate", "errors")).cast("int")
    rows = metrics.select("name", "type", F.explode(roles).alias("r")).select("name", F.col("r.role").alias("role"), F.col("r.hits").alias("hits"), fits.alias("fits")).filter("hits > 0")
    order = Window.partitionBy("role").orderBy(F.desc(F.col("hits") + F.col("fits")), "name")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= best).select("role", "place", "name")


def definitions(files: DataFrame) -> DataFrame:
    """(path, name, kind, help) of metrics that source files define: constructor calls Counter("name", "help") and the like
    in any of the usual languages, found by pattern in each file's text."""
    pattern = r"""(?s)\b(?:New)?(Counter|Gauge|Histogram|Summary)(?:Vec)?\s*\(\s*(?:\w+\.\w+Opts\s*\{\s*Name:\s*)?["']([a-zA-Z_:][a-zA-Z0-9_:]*)["']\s*,\s*(?:Help:\s*)?["']([^"']*)["']"""
    hits = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = files.select("path", hits.alias("hit"))
    part = lambda i: F.regexp_extract("hit", pattern, i)
    return rows.select("path", part(2).alias("name"), F.lower(part(1)).alias("kind"), part(3).alias("help"))


def context_claims(metrics: DataFrame, defined: DataFrame) -> DataFrame:
    """Claims from definitions that a metric's name meets, as it stands or without what a client library appends."""
    stem = F.regexp_replace("name", "_(total|bucket|count|sum|created)$", "")
    own = metrics.select(F.col("name").alias("metric"), F.explode(F.array_distinct(F.array(F.col("name"), stem))).alias("name"))
    found = own.join(defined, "name").select("metric", F.explode(F.array(F.struct(F.lit("kind").alias("field"), F.col("kind").alias("value")), F.struct(F.lit("help").alias("field"), F.col("help").alias("value")))).alias("c"))
    return found.select("metric", "c.*").filter("value <> ''").distinct()
