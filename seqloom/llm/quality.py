"""Quality rules with cross-document line frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import Work, small

#: A line is boilerplate where so many of a host's different texts hold it, whatever the host's size: a line of
#: LONG_WORDS words or more, which texts rarely share by chance, in LONG_LEAST, any other in LINE_LEAST.
LINE_LEAST, LONG_LEAST, LONG_WORDS = 5, 3, 10
#: A document is depleted, and rejected, where boilerplate takes more than this share of its words.
DEPLETED = 0.5
SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """The hash of a line in lower case with single spaces, odd for a line of LONG_WORDS words or more; null for a
    line without words."""
    plain = F.btrim(F.regexp_replace(F.lower(line), SPACE, " "))
    long = (F.length(plain) - F.length(F.translate(plain, " ", "")) >= LONG_WORDS - 1).cast("long")
    return F.when(plain != "", F.xxhash64(plain).bitwiseAND(F.lit(-2)).bitwiseOR(long))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first one included.

    Windows are compared by 40 bits of a hash packed with their position, sorted as plain longs; those that
    meet are then compared as text, so the count is exact. In a text of more words than a position has values, all
    windows are compared as text.
    """

    def windows(w):
        packed = F.transform(w, lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), 24).bitwiseOR(i.cast("long")))
        return F.sort_array(F.slice(packed, F.lit(1), F.greatest(F.lit(0), F.size(w) - 2)))

    def meet(s):
        same = lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), 24) == 0
        return F.filter(s, lambda x, i: ((i > 0) & same(x, F.get(s, i - 1))) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))

    def places(w):
        few = F.transform(_let(windows(w), meet), lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))
        return F.when(F.size(w) < 1 << 24, few).otherwise(F.sequence(F.lit(0), F.size(w) - 3))

    def exact(w, at):
        text = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))
        hit = lambda t: F.filter(t, lambda x, i: ((i > 0) & x["t"].eqNullSafe(F.get(t, i - 1)["t"])) | x["t"].eqNullSafe(F.get(t, i + 1)["t"]))
        return F.sort_array(F.transform(_let(text, hit), lambda x: x["i"]))

    def covered(p):
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(places(words), lambda n: F.when(F.size(n) == 0, F.lit(0).cast("long")).otherwise(_let(exact(words, n), covered))))


def frequent_lines(docs: DataFrame, host: Column, text: Column, least: int, long_least: int, copies: bool = False) -> DataFrame:
    """host, body, size and boilerplate, the keys of boilerplate lines, for each different text that holds any.

    Counts meet as (host, line) after a sum in each task; no list of a host's lines is ever made. A text that a host
    holds several times counts once, or with copies as often as it occurs.
    """
    work = Work(docs.sparkSession, "quality")
    keys = F.array_distinct(F.filter(F.transform(lines_of(text), line_key), lambda k: k.isNotNull()))
    rows = docs.select(host.alias("host"), F.xxhash64(text).alias("body"), F.length(text).alias("size"), keys.alias("keys")).filter(text.isNotNull())
    once = rows.groupBy("host", "body", "size").agg(F.first("keys").alias("keys"), (F.count("*") if copies else F.lit(1)).alias("rows"))
    lines = work.table("once", once).select("host", "body", "size", "rows", F.explode("keys").alias("line"))
    held = lines.groupBy("host", "line").agg(F.sum("rows").alias("n"))
    limit = F.when(F.col("line").bitwiseAND(F.lit(1)) == 1, F.lit(long_least)).otherwise(F.lit(least))
    bad = work.table("bad", held.filter(F.col("n") >= limit).select(F.col("host").alias("bad_host"), F.col("line").alias("bad_line")))
    met = lines.join(small(bad, 200_000), (F.col("line") == F.col("bad_line")) & F.col("host").eqNullSafe(F.col("bad_host")))
    return work.table("texts", met.groupBy("host", "body", "size").agg(F.collect_list("line").alias("boilerplate")))


def judge(docs: DataFrame, text_column: str = "text", host_column: str = "source", least: int = LINE_LEAST, long_least: int | None = None, depleted: float = DEPLETED, copies: bool = False) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left, kept
    and text_left, the text without its boilerplate lines (columns of these names give way).

    Null and empty texts have no words and fail the base rules. Repeats are judged alike; a null host is a host; an
    empty table gives none. The documents that count for a line are a host's different texts, so that copies of one
    clean text do not make boilerplate of all its lines; with copies every row counts.
    """
    mine = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "kept", "text_left"]
    keep = [c for c in docs.columns if c not in mine]
    text, host = F.coalesce(F.col(f"`{text_column}`"), F.lit("")), F.col(f"`{host_column}`")
    long_least = min(least, LONG_LEAST) if long_least is None else long_least
    bad = frequent_lines(docs, host, F.col(f"`{text_column}`"), least, long_least, copies).toDF("qr_host", "qr_body", "qr_size", "boilerplate")
    same = (F.xxhash64(F.col(f"`{text_column}`")) == F.col("qr_body")) & (F.length(F.col(f"`{text_column}`")) == F.col("qr_size")) & host.eqNullSafe(F.col("qr_host"))
    rows = docs.select(*keep).join(small(bad, 200_000), same, "left")
    rows = rows.withColumn("qr_bad", F.coalesce("boilerplate", F.array().cast("array<bigint>")))
    words, lines = words_of(text), lines_of(text)
    with_word = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    left = F.when(F.size("qr_bad") == 0, text).otherwise(F.array_join(F.filter(lines, lambda x: ~F.coalesce(F.array_contains("qr_bad", line_key(x)), F.lit(False))), "\n"))
    facts = _let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )
    dup = _let(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rows = rows.withColumn("qr", facts).withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")).withColumn("n_dup_lines", dup).withColumn("text_left", left)
    rows = rows.withColumn("n_words_left", F.when(F.size("qr_bad") == 0, F.col("qr.n_words")).otherwise(F.size(words_of(F.col("text_left"))).cast("long")))
    failed = (F.col("qr.n_words") < 50) | (100 * F.col("qr.n_repeat_words") > 50 * F.col("qr.n_words"))
    rows = rows.withColumn("base_failed", failed)
    good = ~F.col("base_failed") & (F.col("n_words_left") >= F.col("qr.n_words") * (1 - depleted))
    return rows.select(*keep, "qr.n_words", "qr.word_chars", "n_symbols", "n_dup_lines", "qr.n_repeat_words", "base_failed", "n_words_left", good.alias("kept"), "text_left")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base figures and the verdict on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (
  SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS h FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w))) WHERE n > 1),
rep AS (SELECT r, sum(least(3, coalesce(j - i, 3))) AS n FROM g GROUP BY r),
l AS (SELECT r, source, text, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS x FROM d)),
once AS (SELECT DISTINCT source, text, x FROM l WHERE x <> ''),
bad AS (SELECT source, x FROM once GROUP BY ALL HAVING count(*) >= CASE WHEN length(x) - length(replace(x, ' ', '')) >= 9 THEN 3 ELSE 5 END),
gone AS (SELECT r, sum(length(l.x) - length(replace(l.x, ' ', '')) + 1) AS n FROM l JOIN bad ON l.x = bad.x AND l.source IS NOT DISTINCT FROM bad.source GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(list_count(k) - len(list_distinct(k)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS n_words_left
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS k FROM w) AS w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_words_left >= n_words AS kept, n_words_left FROM f
"""
