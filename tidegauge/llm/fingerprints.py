"""Canonical exact digests, in DataFrame functions alone.

A text's canonical form is its compatibility composition (NFKC) with case folded and white space runs made one space,
trimmed. Its fingerprint is a wide xxhash (two seeds, 128 bits) of that form. Texts with equal fingerprints are compared
byte by byte within their bucket; should different forms ever share a digest, all but the bucket's smallest form get
a suffix that tells them apart.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut_lineage, partitions, table

#: Digests that may be broadcast: 16 bytes and a count each.
MAX_BROADCAST_DIGESTS = 50_000
#: Text bytes of a range of doc_ids, and how many ranges there are at most (then they are larger; a window streams them).
RANGE_BYTES = 64 << 20
MAX_RANGES = 20_000
#: Hashed doc_ids a range that quantiles are taken of.
SAMPLE_PER_RANGE = 1_000
_SEEDS = (0x5BD1E995, 0x27D4EB2F)
# White space that compatibility composition does not make a plain space already.
_SPACES = ("\t", "\n", "\x0b", "\f", "\r", "\x85", "\u1680", "\u2028", "\u2029")


def with_form(rows: DataFrame, source: Column, name: str) -> DataFrame:
    """rows with the canonical form of source; null as empty. ICU's normaliser and case folding are called through SQL's
    reflect; plain ASCII needs neither, since lower() does the same there. Each step is a column of its own, so that
    nothing is computed twice; only texts that do hold spaces side by side meet a regular expression."""
    text = F.col("__text")
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    rows = rows.withColumn("__text", F.coalesce(source, F.lit("")))
    rows = rows.withColumn("__form", F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(again))
    spaced = functools.reduce(lambda x, space: F.replace(x, F.lit(space), F.lit(" ")), _SPACES, F.col("__form"))
    rows = rows.withColumn("__spaced", F.trim(spaced))
    double = F.contains("__spaced", F.lit("  "))
    return rows.withColumn(name, F.when(double, F.regexp_replace("__spaced", " {2,}", " ")).otherwise(F.col("__spaced"))).drop("__text", "__form", "__spaced")


def digest(form: Column) -> Column:
    """128 bits of a canonical form as 32 hexadecimal digits: xxhash64 chained from two seeds."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), form)), 16, "0")) for seed in _SEEDS])


def with_fingerprint(rows: DataFrame, source: Column, form: str, name: str) -> DataFrame:
    return with_form(rows, source, form).withColumn(name, digest(F.col(form)))


def collisions(docs: DataFrame) -> DataFrame:
    """(fingerprint, form): the canonical forms that share a digest with a smaller, different form. Digests of single
    documents need no look at their bytes; the texts of the others are compared inside their buckets, where equal
    forms meet map-side first, so a bucket of many copies moves one form a task."""
    forms = with_fingerprint(docs.select("text"), F.col("text").cast("string"), "form", "fingerprint").drop("text")
    shared = cut_lineage(forms.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"))
    few = shared.count() <= MAX_BROADCAST_DIGESTS
    suspects = forms.join(F.broadcast(shared) if few else shared, "fingerprint", "left_semi")
    ends = suspects.groupBy("fingerprint").agg(F.min("form").alias("low"), F.max("form").alias("high")).filter("low <> high")
    clashing = cut_lineage(ends.select("fingerprint", "low"))
    if clashing.isEmpty():
        return clashing.select("fingerprint", F.col("low").alias("form"))
    return suspects.join(clashing, "fingerprint").filter("form <> low").select("fingerprint", "form").distinct()


def with_suffix(prints: DataFrame, form: str, name: str, clashing: DataFrame) -> DataFrame:
    """Append a digest of other bits to the fingerprints of clashing forms; normally there are none, and no join."""
    if clashing.isEmpty():
        return prints
    marked = clashing.select(F.col("fingerprint").alias(name), F.col("form").alias(form), F.concat(F.lit("-"), F.sha2(F.col("form"), 256)).alias("__suffix"))
    joined = prints.join(marked, [name, form], "left")
    return joined.withColumn(name, F.concat(name, F.coalesce("__suffix", F.lit("")))).drop("__suffix")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_copies, first_doc_id) of every document."""
    clashing = collisions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = with_suffix(with_fingerprint(rows, F.col("text"), "form", "fingerprint"), "form", "fingerprint", clashing).drop("form")
    groups = prints.groupBy("fingerprint").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_doc_id"))
    return prints.join(groups, "fingerprint").select("doc_id", "fingerprint", "n_copies", "first_doc_id")


def _longs(values: list[int | None]) -> Column:
    """An array literal, however long: one expression that is folded once."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _count_up_to(cuts: list[int], x: Column) -> Column:
    """How many of the sorted cuts are at most x: a binary search as one fold, so neither the plan nor the work of a row
    grows with the number of cuts but by its logarithm."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(_longs(cuts), at + step - 1) <= x, at + step).otherwise(at))


def with_next(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, more, next_text, next_...): the text and the columns named in more of the next document in descending doc_id order, the first after the last.

    doc_ids are cut into ranges of about RANGE_BYTES of text, at quantiles of a hashed sample of the ids (which sets only
    where the cuts lie); a window runs inside each range, and each range also gets a copy of the first document of the
    range below it. So texts are dealt out once, and no window holds all rows. Equal doc_ids follow each other by text;
    null doc_ids come last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    size = rows.agg(F.count("doc_id").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    n = min(MAX_RANGES, max(partitions(docs.sparkSession), -(-size["bytes"] // RANGE_BYTES)))
    rate = min(1.0, SAMPLE_PER_RANGE * n / max(1, size["n"]))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = sorted(set(sample.agg(F.percentile_approx("doc_id", shares, max(10_000, 2 * n)).alias("c")).first()["c"] or []))
    # The higher the doc_ids, the lower the range; nulls go to the last.
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - _count_up_to(cuts, F.col("doc_id")))
    tops = rows.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id").alias("top")).collect()
    # A range's first document is also dealt to the range before it; that of the first range, to the last.
    firsts: list[int | None] = [None] * (len(cuts) + 1)
    before: list[int | None] = [None] * (len(cuts) + 1)
    used = sorted(r["part"] for r in tops)
    for r in tops:
        firsts[r["part"]] = r["top"]
    for i, p in enumerate(used):
        before[p] = used[i - 1]
    rows = rows.withColumn("__part", part)
    is_first = F.col("doc_id").eqNullSafe(F.get(_longs(firsts), F.col("__part")))
    ghost = F.when(is_first, F.get(_longs(before), F.col("__part")).cast("int"))
    own = F.struct(F.col("__part").alias("part"), F.lit(0).alias("ghost"))
    copies = F.when(ghost.isNull(), F.array(own)).otherwise(F.array(own, F.struct(ghost.alias("part"), F.lit(1).alias("ghost"))))
    columns = [c for c in rows.columns if c != "__part"]
    dealt = rows.select(*columns, F.explode(copies).alias("at")).select(*columns, "at.part", "at.ghost").repartition(max(1, len(used)), "part")
    order = Window.partitionBy("part").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    ahead = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *more)]
    return dealt.select(*columns, "ghost", *ahead).filter("ghost = 0").drop("ghost")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness: 1 for equal digests of equal forms,
    else 0, since an exact digest knows no degrees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clashing = collisions(docs)
    prints = with_suffix(with_fingerprint(docs, F.col("text").cast("string"), "form", "fingerprint"), "form", "fingerprint", clashing).drop("form")
    rows = with_next(prints, "fingerprint").withColumn("n_chars", F.char_length("text").cast("long"))
    # Of the last floor(n / 3) code points, as many are replaced as the edit cuts; short texts lose none.
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(n_chars / 3) as int))"))
    rows = with_fingerprint(rows.withColumn("edited", edited), F.col("edited"), "edited_form", "edited_fingerprint")
    rows = with_suffix(rows, "edited_form", "edited_fingerprint", clashing)
    # The bytes are compared where the digests are equal; elsewhere the empty text stands in.
    equal = F.col("fingerprint") == F.col("edited_fingerprint")
    rows = with_form(rows, F.when(equal, F.col("text")), "own_form")
    same_form = equal & (F.col("own_form") == F.col("edited_form"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        same_form.cast("double").alias("near_edited"),
        # Fingerprints of documents are equal only for equal forms, as collisions() has seen to.
        (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )


#: DuckDB has no xxhash64 of these seeds and no NFKC; tests compare the query with a plain Python version.
ORACLE = None
