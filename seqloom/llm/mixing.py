"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import small

#: Target shares of documents after mixing: a source not named here gets weight 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
SEED = 17
#: Largest mean drawn at once; a larger mean is the sum of several draws.
STEP = 64.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the parts."""
    digits = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... as an array, far enough that what is left is below 2 ** -53."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(a, k):
        p = a["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["c"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, seed: int = SEED, source_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """The rows, each repeated a Poisson-distributed number of times, globally shuffled.

    A source's mean is its target share of `total` times the number of rows, over its own number of rows; null
    is a source of its own. Columns are those of docs plus mix_copy (1, 2, ...), mix_copies and mix_order (a
    row's place in the shuffle, a hash); a column of one of these names gives way. The draw depends on seed,
    id and source only, so equal ids of a source get equal counts and a lost task draws the same again. Rows
    with a count of 0 go: that is the sampling.
    """
    weights = WEIGHTS if weights is None else weights
    mine = ("mix_copy", "mix_copies", "mix_order")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in mine])
    src, key = F.col(f"`{source_column}`"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null"))
    sizes = docs.groupBy(src.alias("mix_src")).agg(F.count("*").alias("mix_n"))
    given = F.lit(1.0)
    for name, w in weights.items():
        given = F.when(F.col("mix_src") == name, F.lit(float(w))).otherwise(given)
    sizes = sizes.withColumn("mix_w", given)
    whole = sizes.agg(F.sum("mix_w").alias("mix_sum"), F.sum("mix_n").alias("mix_all"))  # one row
    rate = F.col("mix_w") / F.col("mix_sum") * F.col("mix_all") * F.lit(float(total)) / F.col("mix_n")
    rates = sizes.crossJoin(F.broadcast(whole)).withColumn("mix_rate", rate).withColumn("mix_draws", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / STEP)).cast("int"))
    rates = rates.withColumn("mix_cdf", poisson_cdf(F.col("mix_rate") / F.col("mix_draws"))).select("mix_src", "mix_draws", "mix_cdf")
    # a row for each source: counted before it is broadcast, else the join on the source splits hot ones
    rows = docs.join(small(rates, 10_000), src.eqNullSafe(F.col("mix_src")))
    name = F.coalesce(src, F.lit("null"))
    one = lambda d: F.size(F.filter("mix_cdf", lambda c: c < uniform(F.lit(str(seed)), name, key, d.cast("string"))))
    few = F.size(F.filter("mix_cdf", lambda c: c < F.col("mix_u")))
    rows = rows.withColumn("mix_u", uniform(F.lit(str(seed)), name, key, F.lit("1")))
    rest = F.when(F.col("mix_draws") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("mix_draws"))), F.lit(0), lambda a, d: a + one(d))).otherwise(F.lit(0))
    rows = rows.withColumn("mix_copies", few + rest).filter("mix_copies > 0")
    rows = rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"), "mix_copies")
    rows = rows.withColumn("mix_order", F.xxhash64(F.lit(seed), name, key, "mix_copy"))
    # a hash range to each partition, sorted inside it: a global shuffle in files' order. The hash is uniform, so ranges
    # of equal width hold equal shares and nothing has to be sampled
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.shiftright((F.shiftright("mix_order", 32) + (1 << 31)) * parts, 32).cast("int")
    return rows.repartitionById(parts, place).sortWithinPartitions("mix_order")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to WEIGHTS: a row for each copy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "source", F.length("text").alias("n_chars"), "mix_copy", "mix_copies")


ORACLE = """
WITH RECURSIVE s AS (SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 4.0 WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END AS w FROM documents GROUP BY 1),
r AS (SELECT source, CAST(w AS DOUBLE) / (SELECT sum(CAST(w AS DOUBLE)) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
p(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
u AS (SELECT doc_id, source, length(text) AS n_chars, (CAST(CAST('0x' || substr(sha256('17|' || source || '|' || doc_id || '|1'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT doc_id, any_value(u.source) AS source, any_value(n_chars) AS n_chars, CAST(count(*) AS INTEGER) AS mix_copies FROM u JOIN p ON u.source = p.source AND c < u GROUP BY doc_id)
SELECT doc_id, source, n_chars, CAST(unnest(range(1, mix_copies + 1)) AS INTEGER) AS mix_copy, mix_copies FROM k
"""
