"""Mixing sources to target weights by Pareto order sampling of documents.

A document's size is its number of words. The mix as a whole takes as many words as there are; each
source gets a target by its weight, at most `cap` times its own size, and what it cannot take goes
to the others by weight until none is above.

Within a source a document's expected number of copies grows with the whole square root of its size
(longer documents are likelier, short ones are not shut out), is at most `cap`, and such that the
expected words are the source's target. Its whole copies are certain. The rest of the expectation is
the probability p of one more: documents are ranked by random odds u / (1 - u) over inclusion odds
p / (1 - p), u being a hash of seed and id, and taken in this order while they fit into the words that
the certain copies leave of the target. So the sample's size is fixed in words, up to one document. Then
CLOSING times, where it helps, a copy of the document whose size is nearest to the gap is added, or taken back.

The order of all documents comes from a range sort with a row for each range and source to carry sums
across, so a source of any share of the rows is spread over tasks. Only sums of sizes and weights reach
the driver. Everything is decided by integers, hashes and single operations on doubles: reruns agree.

A null or empty text has size 0 and nothing is taken of it; a source of such texts has target 0. A null
source is a source, the last. Null ids share the hash of an empty id. Rows that repeat an id, a size and a
source are interchangeable. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import numbered, ranges
from .common import documents, drop, written

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
CLOSING = 4


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and measure: the whole square root of the size."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    return rows.withColumn("measure", F.floor(F.sqrt("size")).cast("long"))


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (with source_size and weight) and their target: weighted shares of all sizes, none above cap times its own.

    Each round caps the sources whose share is above and shares the rest anew; two sums reach the driver."""
    whole, share = sources.agg(F.sum("source_size")).first()[0] or 0, F.lit(0.0)
    at_cap = F.lit(False)
    capped = -1
    while True:
        r = sources.agg(F.sum(F.when(at_cap, cap * F.col("source_size"))).alias("full"), F.sum(F.when(~at_cap, F.col("weight"))).alias("open"), F.count_if(at_cap).alias("n")).first()
        if r["n"] == capped or not r["open"]:
            return sources.withColumn("target", F.when(at_cap, (cap * F.col("source_size")).cast("double")).otherwise(share))
        capped = r["n"]
        share = F.lit(float(whole - (r["full"] or 0))) * F.col("weight") / F.lit(float(r["open"]))
        at_cap = cap * F.col("source_size") <= share


def expected_copies(levels: DataFrame, cap: int = CAP) -> DataFrame:
    """levels (place, measure, words, target) with copies: min(cap, c * measure), c such that a source's expected words are its target.

    A source has a row for each whole square root of its sizes."""
    down = W.partitionBy("place").orderBy(F.desc("measure"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("measure")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    factor = (F.col("target") - (cap * above).cast("double")) / rest.cast("double")
    # The largest measure that stays under the cap if all larger ones are at it.
    fits = F.max(F.when(F.col("factor") * F.col("measure") <= cap, F.struct("measure", "factor"))).over(W.partitionBy("place"))["factor"]
    out = levels.withColumn("factor", factor).withColumn("c", fits)
    return out.withColumn("copies", F.coalesce(F.least(F.lit(float(cap)), F.col("c") * F.col("measure")), F.lit(float(cap)))).drop("factor", "c")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole copies that the mix takes), taken (their words)."""
    spark, rows = docs.sparkSession, written(sizes(docs), "sizes")
    levels = written(rows.groupBy("source", "measure").agg(F.sum("size").alias("words")), "levels")
    named = numbered(levels.groupBy("source").agg(F.sum("words").alias("source_size")), "place", F.asc_nulls_last("source"))
    cycle = F.array(*map(F.lit, weights))
    sources = written(targets(named.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))), cap), "sources")
    by_source = lambda left, right, how="inner": left.join(right.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")
    known = written(expected_copies(by_source(levels.where("measure > 0"), sources.select("source", "place", "target")), cap).withColumn("certain", F.floor("copies")), "copies")
    drop(levels)
    left = known.groupBy("place").agg((F.first("target") - F.sum(F.col("certain") * F.col("words")).cast("double")).alias("left"))
    per_level = known.select(F.col("source").alias("_source"), F.col("measure").alias("_measure"), "certain", (F.col("copies") - F.col("certain")).alias("p"))
    full = by_source(rows, sources.select("source", "place", "source_size", "target"))
    full = full.join(per_level, F.col("source").eqNullSafe(F.col("_source")) & (F.col("measure") == F.col("_measure")), "left").drop("_source", "_measure")
    full = full.withColumns({"certain": F.coalesce("certain", F.lit(0)), "p": F.coalesce("p", F.lit(0.0))})

    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    some = full.where("size > 0").withColumn("u", u).withColumn("key", F.when(F.col("p") > 0, odds))
    order = [F.asc("place"), F.asc_nulls_last("key"), F.asc_nulls_last("doc_id"), F.asc("size")]
    ranked = ranges(some.drop("u", "p", "measure"), *order)
    rest = full.where("size = 0").withColumn("copies", F.col("certain"))

    # Words before each document in its source: of earlier ranges, and of its own.
    part = F.shiftright("at", 33)
    sums = ranked.groupBy("place", part.alias("part")).agg(F.sum("size").alias("own"))
    before = sums.withColumn("before", F.coalesce(F.sum("own").over(W.partitionBy("place").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).join(left, "place")
    along = W.partitionBy("place", "part").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    until = ranked.withColumn("part", part).join(before.drop("own"), ["place", "part"]).withColumn("until", F.col("before") + F.sum("size").over(along))
    fits = (F.col("key").isNotNull() & (F.col("until") <= F.col("left"))).cast("long")
    mixed = written(until.withColumn("fits", fits).withColumn("copies", F.col("certain") + F.col("fits")).drop("before", "until", "part"), "fitting")

    gaps = written(mixed.groupBy("place").agg((F.first("left") - F.sum(F.col("fits") * F.col("size")).cast("double")).alias("gap")), "gaps")
    moves = spark.createDataFrame([], "place long, at long, change long")
    miss = F.abs(F.abs("gap") - F.col("size"))
    for _ in range(CLOSING):
        now = mixed.select("place", "at", "key", "doc_id", "size", "copies").join(moves.groupBy("place", "at").agg(F.sum("change").alias("change")), ["place", "at"], "left")
        now = now.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).join(gaps, "place").withColumn("step", F.signum("gap").cast("long"))
        helps = now.where((miss < F.abs("gap")) & (F.col("copies") + F.col("step")).between(0, cap))
        best = F.min(F.struct(miss.alias("miss"), F.col("key").isNull().alias("no_key"), "key", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size", "copies", "at", "step"))
        found = written(helps.groupBy("place").agg(best.alias("best")).select("place", "best.at", F.col("best.step").alias("change"), F.col("best.size").alias("size")), "moves")  # a row a source at most
        gaps = written(gaps.join(found.select("place", (F.col("change") * F.col("size")).alias("by")), "place", "left").select("place", (F.col("gap") - F.coalesce("by", F.lit(0))).alias("gap")), "gaps")
        moves = moves.union(found.select("place", "at", "change"))
    taken = mixed.join(moves.groupBy("place", "at").agg(F.sum("change").alias("change")), ["place", "at"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    names = ["doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken")]
    return taken.select(*names).union(rest.select(*names))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP11_SQL = r"""
WITH sized AS (
    SELECT row_number() OVER () AS nth, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
measured AS (SELECT *, floor(sqrt(size))::BIGINT AS measure FROM sized),
sources AS (
    SELECT source, source_size, CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS weight
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM measured GROUP BY source)),
filled AS (
    SELECT *, row_number() OVER fill AS k, sum(source_size) OVER () - 3 * (sum(source_size) OVER fill - source_size) AS room, sum(weight) OVER () - (sum(weight) OVER fill - weight) AS open
    FROM sources WINDOW fill AS (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
stop AS (SELECT room, open, k FROM filled WHERE 3 * source_size > room::DOUBLE * weight / open::DOUBLE ORDER BY k LIMIT 1),
targets AS (
    SELECT source, source_size, CASE WHEN filled.k < coalesce((SELECT k FROM stop), 9223372036854775807) THEN (3 * source_size)::DOUBLE ELSE (SELECT room::DOUBLE * weight / open::DOUBLE FROM stop) END AS target
    FROM filled),
levels AS (SELECT source, measure, sum(size) AS words FROM measured WHERE measure > 0 GROUP BY ALL),
factors AS (
    SELECT l.source, measure, words, target, (target - (3 * (sum(words) OVER down - words))::DOUBLE) / (sum(words * measure) OVER (PARTITION BY l.source ORDER BY measure ROWS UNBOUNDED PRECEDING))::DOUBLE AS factor
    FROM levels l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source WINDOW down AS (PARTITION BY l.source ORDER BY measure DESC ROWS UNBOUNDED PRECEDING)),
copies AS (
    SELECT source, measure, words, target, coalesce(least(3.0::DOUBLE, measure * arg_max(factor, measure) FILTER (factor * measure <= 3) OVER (PARTITION BY source)), 3.0::DOUBLE) AS copies FROM factors),
residual AS (SELECT source, any_value(target) - sum(floor(copies)::BIGINT * words)::DOUBLE AS rest FROM copies GROUP BY source),
full_rows AS (
    SELECT m.nth, m.doc_id, m.source, m.size, t.source_size, t.target, coalesce(floor(c.copies), 0)::BIGINT AS certain, coalesce(c.copies - floor(c.copies), 0) AS p,
        (('0x' || substr(md5('11:' || coalesce(m.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u
    FROM measured m JOIN targets t ON m.source IS NOT DISTINCT FROM t.source LEFT JOIN copies c ON m.source IS NOT DISTINCT FROM c.source AND m.measure = c.measure),
keyed AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS key FROM full_rows WHERE size > 0),
fitting AS (
    SELECT k.*, rest, p > 0 AND sum(size) OVER (PARTITION BY k.source ORDER BY key NULLS LAST, doc_id NULLS LAST, size, nth ROWS UNBOUNDED PRECEDING) <= rest AS fits
    FROM keyed k JOIN residual r ON k.source IS NOT DISTINCT FROM r.source),
near0 AS (
    SELECT nth, doc_id, source, size, source_size, target, key, certain + fits::INT AS copies, rest - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY source), 0)::DOUBLE AS gap FROM fitting),
CLOSE
taken AS (
    SELECT doc_id, size, source_size, target, copies FROM LAST
    UNION ALL SELECT doc_id, size, source_size, target, certain FROM full_rows WHERE size = 0)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM taken
""".replace(
    "CLOSE",
    "\n".join(
        f"""helps{k} AS (SELECT *, abs(abs(gap) - size) < abs(gap) AND copies + sign(gap) BETWEEN 0 AND 3 AS can FROM near{k}),
picked{k} AS (
    SELECT *, can AND row_number() OVER (PARTITION BY source, can ORDER BY abs(abs(gap) - size), key NULLS LAST, doc_id NULLS LAST, size, copies, nth) = 1 AS pick FROM helps{k}),
near{k + 1} AS (
    SELECT nth, doc_id, source, size, source_size, target, key, copies + pick::INT * sign(gap)::INT AS copies, gap - sum(pick::INT * sign(gap)::INT * size) OVER (PARTITION BY source)::DOUBLE AS gap FROM picked{k}),"""
        for k in range(CLOSING)
    ),
).replace("LAST\n", f"near{CLOSING}\n")
