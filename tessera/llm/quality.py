"""Quality rules with thresholds learned from quantile sketches of each language and source. DataFrame functions only.

The sketch of a measure is a histogram over fixed buckets: each integer below 64, then 32 buckets an octave, so a
quantile is off by 1/32 of its value at most. Sketches merge by adding counts: partial aggregation makes them on each
executor. A group's fence is blended with its language's, and that with the fence of all documents, by their numbers of
documents: what few documents say counts for little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded, settle

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: How many documents of the wider group a fence of the wider group counts for in a blend.
WIDER = 100
#: measure: (quantile, spread quantile, times the spread, least room). An upper fence is q + times * (q - spread) + room.
FENCES = {
    "symbols": (75, 25, 3, 30),
    "dup_lines": (75, 25, 3, 30),
    "repeats": (75, 25, 3, 100),
    "length": (75, 25, 6, 200),
}


def measures(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang, source and the counts of each whole text. Null texts have no words; null lang or source is a value."""
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = base.withColumn("w", F.array_remove(F.split("text", SPACE), "")).withColumn("lines", F.expr(r"filter(split(text, '\n'), l -> length(translate(l, ' \t\n\u000b\u000c\r', '')) > 0)"))
    counts = words.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(w) >= 8 THEN transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8))) END").alias("h"),
    )
    # Only texts with an equal pair of windows are sorted; windows are known by 64-bit hashes within one text.
    paired = counts.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS p))) END")).drop("h")
    at = paired.withColumn("p", F.expr("sort_array(filter(transform(s, (x, j) -> CASE WHEN coalesce(get(s, j - 1).h = x.h, false) OR coalesce(get(s, j + 1).h = x.h, false) THEN x.p ELSE -1 END), x -> x >= 0))")).drop("s")
    covered = "aggregate(p, named_struct('last', -8, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(8, x - a.last)), a -> a.n)"
    return at.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("p")


def rates(m: DataFrame) -> DataFrame:
    """The measures that have fences, as whole numbers: per thousand words, and hundredths of a character a word."""
    per = lambda c: F.expr(f"CASE WHEN n_words > 0 THEN (1000 * {c}) div n_words ELSE 0 END")
    return m.withColumns({
        "symbols": per("n_symbols"), "dup_lines": per("n_dup_lines"), "repeats": per("n_repeat_words"),
        "length": F.expr("CASE WHEN n_words > 0 THEN (100 * word_chars) div n_words ELSE 0 END"),
    })


def bucket(v: Column) -> Column:
    e = F.length(F.bin(v)) - 1
    return F.when(v < 64, v).otherwise((e.cast("long") * 32 + F.call_function("shiftright", v, (e - 5).cast("int")) - 32).cast("long")).cast("long")


def bucket_floor(b: Column) -> Column:
    e = F.floor(b / 32).cast("int")
    return F.when(b < 192, b).otherwise(F.call_function("shiftleft", (b % 32 + 32).cast("long"), e - 5)).cast("long")


def sketches(r: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n): the sketches of each language and source, of languages and of all."""
    long = r.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.col(k)).alias("bucket")) for k in FENCES])).alias("x")).select("lang", "source", "x.*")
    fine = settle(long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n")), "sketches")
    lang = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "measure", "bucket", "n")
    every = fine.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bucket", "n")
    return fine.select(F.lit(0).alias("level"), "lang", "source", "measure", "bucket", "n").union(lang).union(every)


def fences(sk: DataFrame) -> DataFrame:
    """One row for each level and group: n documents and an upper fence of each measure."""
    group = ["level", "lang", "source", "measure"]
    w = Window.partitionBy(*group).orderBy("bucket")
    cum = sk.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, bucket_floor(F.col("bucket"))))
    rows = cum.groupBy(*group).agg(q(25).alias("q25"), q(75).alias("q75"), F.max("total").alias("n"))
    value = F.lit(None).cast("long")
    for k, (_, _, times, room) in FENCES.items():
        value = F.when(F.col("measure") == k, F.col("q75") + times * (F.col("q75") - F.col("q25")) + room).otherwise(value)
    each = rows.withColumn("fence", value)
    return each.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("measure") == k, F.col("fence"))).alias(f"max_{k}") for k in FENCES])


def blended(f: DataFrame, wider: int = WIDER) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Fences of languages and sources, of languages, and of all (none where no document passes): each (n * its own + wider * the wider one's) div (n + wider)."""
    cut = [f"max_{k}" for k in FENCES]
    every = f.filter("level = 2").select(*cut).first()  # one row
    every = {c: int(every[c]) for c in cut} if every else {}
    mean = lambda own, above: F.expr(f"(n * {own} + {wider} * {above}) div (n + {wider})")
    lang = f.filter("level = 1").select(F.col("lang").alias("l1"), *[mean(c, every.get(c, 0)).alias(f"{c}_1") for c in cut])
    own = f.filter("level = 0").join(lang, F.col("lang").eqNullSafe(F.col("l1"))).select(F.col("lang").alias("l0"), F.col("source").alias("s0"), *[mean(c, f"{c}_1").alias(f"{c}_0") for c in cut])
    return own, lang, every


def quality_filter(docs: DataFrame, wider: int = WIDER) -> DataFrame:
    """doc_id, the counts, base_failed, the group's fences and kept: not base_failed and no measure above its fence.

    One row for each row of docs, whatever repeats. Fences come from all rows that pass the base rules; a group without
    such rows has its language's, a language without them that of all; if no row passes, fences are null and none is kept.
    Null lang and source group together. Jobs run while the plan is made.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    r = settle(rates(measures(docs)).withColumn("base_failed", base), "measures")
    own, lang, every = blended(settle(fences(sketches(r.filter("NOT base_failed"))), "fences"), wider)
    joined = r.join(bounded(settle(own, "own")), F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left").join(bounded(lang), F.col("lang").eqNullSafe(F.col("l1")), "left")
    limit = {f"max_{k}": F.coalesce(F.col(f"max_{k}_0"), F.col(f"max_{k}_1"), F.lit(every.get(f"max_{k}")).cast("long")) for k in FENCES}
    fine = F.lit(True)
    for k in FENCES:
        fine = fine & (F.col(k) <= limit[f"max_{k}"])
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(fine, F.lit(True))).alias("kept"), *[x.alias(c) for c, x in limit.items()])


ORACLE = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
c AS (SELECT doc_id, lang, source, w, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM c WHERE n_words >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY doc_id),
m AS (SELECT c.doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM c LEFT JOIN p ON c.doc_id = p.doc_id),
x AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN (1000 * n_symbols) // n_words ELSE 0 END AS symbols, CASE WHEN n_words > 0 THEN (1000 * n_dup_lines) // n_words ELSE 0 END AS dup_lines,
  CASE WHEN n_words > 0 THEN (1000 * n_repeat_words) // n_words ELSE 0 END AS repeats, CASE WHEN n_words > 0 THEN (100 * word_chars) // n_words ELSE 0 END AS "length" FROM m),
u AS (SELECT lang, source, measure, v FROM (
  SELECT lang, source, 'symbols' AS measure, symbols AS v FROM x WHERE NOT base_failed UNION ALL SELECT lang, source, 'dup_lines', dup_lines FROM x WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeats', repeats FROM x WHERE NOT base_failed UNION ALL SELECT lang, source, 'length', "length" FROM x WHERE NOT base_failed)),
f AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS lo FROM u),
s AS (SELECT 0 AS level, lang, source, measure, lo, count(*) AS n FROM f GROUP BY lang, source, measure, lo
  UNION ALL SELECT 1, lang, NULL, measure, lo, count(*) FROM f GROUP BY lang, measure, lo UNION ALL SELECT 2, NULL, NULL, measure, lo, count(*) FROM f GROUP BY measure, lo),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY lo) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM s),
q AS (SELECT level, lang, source, measure, max(total) AS n, min(CASE WHEN upto * 100 >= total * 25 THEN lo END) AS q25, min(CASE WHEN upto * 100 >= total * 75 THEN lo END) AS q75 FROM cum GROUP BY level, lang, source, measure),
e AS (SELECT level, lang, source, measure, n, q75 + CASE measure WHEN 'length' THEN 6 ELSE 3 END * (q75 - q25) + CASE measure WHEN 'length' THEN 200 WHEN 'repeats' THEN 100 ELSE 30 END AS fence FROM q),
h AS (SELECT level, lang, source, max(n) AS n, max(CASE WHEN measure = 'symbols' THEN fence END) AS a, max(CASE WHEN measure = 'dup_lines' THEN fence END) AS b,
  max(CASE WHEN measure = 'repeats' THEN fence END) AS c, max(CASE WHEN measure = 'length' THEN fence END) AS d FROM e GROUP BY level, lang, source),
v1 AS (SELECT l.lang, (l.n * l.a + 100 * t.a) // (l.n + 100) AS a, (l.n * l.b + 100 * t.b) // (l.n + 100) AS b, (l.n * l.c + 100 * t.c) // (l.n + 100) AS c, (l.n * l.d + 100 * t.d) // (l.n + 100) AS d
  FROM h l, h t WHERE l.level = 1 AND t.level = 2),
v0 AS (SELECT g.lang, g.source, (g.n * g.a + 100 * l.a) // (g.n + 100) AS a, (g.n * g.b + 100 * l.b) // (g.n + 100) AS b, (g.n * g.c + 100 * l.c) // (g.n + 100) AS c, (g.n * g.d + 100 * l.d) // (g.n + 100) AS d
  FROM h g JOIN v1 l ON g.lang IS NOT DISTINCT FROM l.lang WHERE g.level = 0)
SELECT x.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND symbols <= coalesce(h0.a, h1.a, h2.a) AND dup_lines <= coalesce(h0.b, h1.b, h2.b) AND repeats <= coalesce(h0.c, h1.c, h2.c) AND "length" <= coalesce(h0.d, h1.d, h2.d) AS kept,
  CAST(coalesce(h0.a, h1.a, h2.a) AS BIGINT) AS max_symbols, CAST(coalesce(h0.b, h1.b, h2.b) AS BIGINT) AS max_dup_lines, CAST(coalesce(h0.c, h1.c, h2.c) AS BIGINT) AS max_repeats, CAST(coalesce(h0.d, h1.d, h2.d) AS BIGINT) AS max_length
FROM x LEFT JOIN v0 h0 ON h0.lang IS NOT DISTINCT FROM x.lang AND h0.source IS NOT DISTINCT FROM x.source
LEFT JOIN v1 h1 ON h1.lang IS NOT DISTINCT FROM x.lang LEFT JOIN h h2 ON h2.level = 2
"""
