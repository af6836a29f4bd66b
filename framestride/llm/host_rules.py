"""Operator 9, quality rules: rule failures by host, shrunk with an empirical beta prior.

Every document gets counts from its whole text by built-in functions inside its
own row (no explode, so a long or repetitive text costs only itself). Documents
failing a rule are summed by host (a partial sum per task, so a host with a
third of all rows is one small row for each task), rates are shrunk towards the
mean of all hosts with a beta prior fitted by the method of moments, and the
verdict is joined back; the join's host side is one row for each host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.common import WS, WS_CHARS, Scratch, guarded, let, pick, small, table


@dataclass(frozen=True)
class HostRules:
    """A document fails if ``base_failed`` or one of the soft limits is passed."""

    min_words: int = 50
    #: Per cent of words in repeated 3-word windows.
    max_repeat_pct: int = 50
    #: Symbols for each 100 words.
    max_symbol_pct: int = 100
    #: Lines equal to an earlier one, for each 100 words.
    max_dup_line_pct: int = 10
    #: A host whose shrunk failure rate is above this loses its documents.
    max_host_rate: float = 0.5
    #: Bounds of the prior's weight in documents.
    prior_weight: tuple[float, float] = (1.0, 1000.0)


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array, first ones included.

    Each window becomes one long: the low bits of its 64-bit hash, then its
    position. Sorting these longs brings equal windows together with their
    places, in n log n whatever the repetition. Neighbours of equal hash are
    compared word by word; where other words stand beside each other, which the
    shorter hash of a text of a million words makes likely, the text is sorted
    by 96 bits of hash instead. So the count is exact at any length.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def three(i: Column) -> list[Column]:
            return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

        def equal(i: Column, j: Column) -> Column:
            return F.get(w, i).eqNullSafe(F.get(w, j)) & F.get(w, i + 1).eqNullSafe(F.get(w, j + 1)) & F.get(w, i + 2).eqNullSafe(F.get(w, j + 2))

        def total(places: Column) -> Column:
            return let(F.sort_array(places), lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))).cast("long")),
                F.lit(0).cast("long"), lambda a, x: a + x))

        def short(s: Column) -> Column:
            def at(x: Column) -> Column:
                return x.bitwiseAND(mask).cast("int")

            def same(a: Column, b: Column) -> Column:
                return F.coalesce(F.call_function("shiftrightunsigned", a.bitwiseXOR(b), bits) == 0, F.lit(False))

            clash = F.exists(F.transform(s, lambda x, k: same(x, F.get(s, k + 1)) & ~equal(at(x), at(F.get(s, k + 1)))), lambda x: x)
            flagged = F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)))
            return F.when(clash, let(F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(*three(i)).alias("h"), F.hash(*three(i)).alias("g"), i.alias("i")))), full)).otherwise(total(F.transform(flagged, at)))

        def full(s: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]) & equal(x["i"], y["i"]), F.lit(False))

            return total(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1))), lambda x: x["i"]))

        places = F.sequence(F.lit(0), n - 3)
        keys = F.transform(places, lambda i: F.call_function("shiftleft", F.xxhash64(*three(i)), bits).bitwiseOR(i.cast("long")))
        return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(keys), short))

    return let(words, of)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{WS}]+")))


def with_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words`` (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    counts = let(word_array(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    return df.select(
        "*", counts.alias("_w"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("_n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("_n_dup_lines"),
    ).select(*df.columns, F.col("_w.n_words").alias("_n_words"), F.col("_w.word_chars").alias("_word_chars"), "_n_symbols", "_n_dup_lines", F.col("_w.n_repeat_words").alias("_n_repeat_words"))


def with_failures(df: DataFrame, rules: HostRules) -> DataFrame:
    """Adds ``_base_failed`` and ``_failed`` (base or soft limits)."""
    words = F.col("_n_words")
    base = (words < rules.min_words) | (100 * F.col("_n_repeat_words") > rules.max_repeat_pct * words)
    soft = (100 * F.col("_n_symbols") > rules.max_symbol_pct * words) | (100 * F.col("_n_dup_lines") > rules.max_dup_line_pct * words)
    return df.withColumn("_base_failed", base).withColumn("_failed", base | soft)


def host_verdicts(counted: DataFrame, host: str, rules: HostRules) -> DataFrame:
    """One row for each host: ``_host, _host_rate`` (shrunk) and ``_host_bad``.

    The prior beta(m k, (1 - m) k) has the mean m and the variance of the hosts'
    raw rates; without variance its weight is the upper bound. A null host is a
    host of its own. The two figures of the prior are one row.
    """
    hosts = counted.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("_docs"), F.sum(F.col("_failed").cast("long")).alias("_bad"))
    rate = F.col("_bad") / F.col("_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    m, v = prior["m"] or 0.0, prior["v"] or 0.0
    low, high = rules.prior_weight
    k = high if v <= 0 else min(high, max(low, m * (1 - m) / v - 1))
    shrunk = (F.col("_bad") + F.lit(m * k)) / (F.col("_docs") + F.lit(k))
    return hosts.select("_host", shrunk.alias("_host_rate"), (shrunk > rules.max_host_rate).alias("_host_bad"))


def judge(docs: DataFrame, scratch: Scratch, rules: HostRules = HostRules(), text: str = "text", host: str = "source", keep_text: bool = True) -> tuple[DataFrame, list[str]]:
    """Counts, ``_base_failed``, ``_failed``, ``_host_rate`` and ``_kept`` beside every row; and the names of the kept columns.

    Null text has no words and fails; an empty table gives no rows; repeated rows
    count each time. The counted rows are written once to the shared folder, so
    texts are read and counted once.
    """
    rows, kept = guarded(docs, text, host)
    counted = with_failures(with_counts(rows, f"_{text}"), rules)
    counted = counted.drop(f"_{text}") if keep_text else counted.drop(f"_{text}", f"_c{docs.columns.index(text)}")
    counted = scratch.save(counted)
    # one row for each host: without the shuffle of whole texts unless there are very many hosts
    verdicts = small(scratch.save(host_verdicts(counted, f"_{host}", rules)))
    out = counted.join(verdicts, F.col(f"_{host}").eqNullSafe(F.col("_host")), "left")
    return out.withColumn("_kept", ~F.col("_base_failed") & ~F.coalesce("_host_bad", F.lit(False))), kept


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, plus ``host_rate`` rounded to 6 places.

    Null and empty texts have no words and fail; very long ones are counted
    whole and exactly; a null source is a host of its own; repeated rows and
    equal ids count each time; an empty table gives none; further columns don't matter.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    out, _ = judge(docs, Scratch(spark, "op9"), keep_text=False)
    return out.select(
        F.col("_c0").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"), F.col("_n_repeat_words").alias("n_repeat_words"),
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.round("_host_rate", 6).alias("host_rate"))


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns whatever their names.

    Nulls, empty and very long texts, ties and repeated rows as in ``op9_host_rules``.
    """
    out, kept = judge(docs, Scratch(spark, "rules"))
    return out.filter("_kept").select(*kept).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT rid, unnest(range(len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3
), h AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i + 1], w[i + 2], w[i + 3]) AS c FROM g
), r AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY rid
), l AS (
  SELECT rid, count(*) - count(DISTINCT x) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid
), c AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 100 * n_words OR 100 * n_dup_lines > 10 * n_words AS soft FROM c
), s AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft) AS bad FROM f GROUP BY source
), m AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM s),
p AS (SELECT m, CASE WHEN v <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) END AS k FROM m),
v AS (SELECT source, (bad + m * k) / (n + k) AS rate FROM s, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rate > 0.5 AS kept, round(rate, 6) AS host_rate
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
