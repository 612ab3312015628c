"""Quality rules with host verdicts, in DataFrame functions only.

Base rules count symbols, repeated lines and repeated words of every text.  Failures are then summed by host, each
host's failure rate is shrunk towards the corpus by a beta prior fitted to the hosts by moments, and a host whose
shrunken rate is above ``host_limit`` with ``margin`` posterior deviations to spare fails with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
SYMBOL_RE = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text without nulls."""
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def base_rules(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, host and the base counts of each document; words in a window found twice or more count as repeated."""
    df = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(window)]))
    df = df.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL_RE)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= window, grams).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    # only texts that repeat a window sort their windows: (hash, place), then the places whose neighbour has the same hash
    places = F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), places)).drop("grams")
    same = lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"])
    df = df.withColumn("at", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(F.filter("sorted", lambda x, k: F.coalesce(same(x, k), (x["h"] == F.get("sorted", k + 1)["h"]), (x["h"] == F.get("sorted", k - 1)["h"]))), lambda x: x["i"])))).drop("sorted")
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(window), F.coalesce(F.get("at", k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def host_rules(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, host_limit: float = 0.5, margin: float = 2.0) -> DataFrame:
    """Base counts, base_failed, the host's shrunken failure rate and ``kept`` of each document.

    A null text is empty (and fails, having no words); a null source is the host ''; texts of any length are judged
    whole; each row is judged by itself, repeated rows too; rows without doc_id are left out, of the hosts' rates as
    well; an empty table gives an empty result; other columns are ignored.  Windows are equal by 64-bit hashes.

    The prior's variance is that of the hosts' observed rates, chance included, so rates are shrunk a little less than
    by an estimate freed of it; the prior weighs as much as 2 documents at least and 1,000 at most.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rules = stored(base_rules(docs).withColumn("base_failed", failed), "rules")
    hosts = rules.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("f"))
    # moments of the hosts' rates, weighted by their documents: m, and the variance between hosts
    moments = hosts.agg((F.sum("f") / F.sum("n")).alias("m"), (F.sum(F.col("f") * F.col("f") / F.col("n")) / F.sum("n")).alias("s"))
    moments = moments.select("m", F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(1e-6)).alias("v"))
    strength = moments.select(F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(2.0)), F.lit(1000.0))).scalar()
    mean = moments.select("m").scalar()
    post = hosts.withColumn("weight", F.col("n") + strength).withColumn("host_rate", (F.col("f") + strength * mean) / F.col("weight"))
    spread = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("weight") + 1))
    verdicts = post.select("host", "host_rate", (F.col("host_rate") - margin * spread > host_limit).alias("host_failed"))
    return rules.join(verdicts, "host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), F.round("host_rate", 6).alias("host_rate")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS x(k) GROUP BY doc_id),
b AS (SELECT w.doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM f GROUP BY host),
m0 AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS s FROM h),
m AS (SELECT m, least(greatest(m * (1 - m) / greatest(s - m * m, 1e-6) - 1, 2.0), 1000.0) AS k FROM m0),
p AS (SELECT host, n + k AS weight, (f + k * m) / (n + k) AS rate FROM h, m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (rate - 2.0 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5) AS kept, round(rate, 6) AS host_rate
FROM f JOIN p USING (host)
"""
