"""Operator 8, secret scans: patterns, and sliding-window entropy over candidate strings.

All work stays inside the row in built-in functions. Pieces between matches and
matches alternate, so their lengths give every match's place. Candidates of the
entropy method are long runs of key characters. Words that a delimiter sets off at
either end (a path, a slug, the name before a ``=``) are no part of the key; what is
left has a class by its characters: hexadecimal, letters, base32, base64. A window
slides over it, with a count for each character of the class that is kept from step
to step, several counts to a number: the sum of c log2 c changes by the counts of the
entering and of the leaving character alone, and gives the Shannon entropy of the
window. Sums are whole numbers, so they don't drift. Each class has a threshold of
its own; the allow-list is asked for what is left, not for the run around it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.common import let, pick, table

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Characters in a window, and the least length of a candidate.
WINDOW = 24
RUN = "A-Za-z0-9+/=_-"
CANDIDATE = rf"(?<![{RUN}])[{RUN}]{{{WINDOW},}}+"
#: Signs that set words of a path, a slug or an assignment apart.
DELIMITERS = "[/=_-]"
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_UUID_BACK = "[0-9a-f]{12}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{8}"
#: What is a word: of one case, capitalised, in camel case, with a number behind, a number, an identifier with dashes.
WORD = f"{_UUID}|[a-z]{{1,20}}(?:[A-Z][a-z]{{2,19}}){{0,6}}|(?:[A-Z][a-z]{{1,19}}){{1,6}}|[A-Z]{{1,20}}|[0-9]{{1,8}}|[A-Za-z]{{1,12}}[0-9]{{1,4}}"
#: The same read backwards.
WORD_BACK = f"{_UUID_BACK}|(?:[a-z]{{2,19}}[A-Z]){{0,6}}[a-z]{{1,20}}|(?:[a-z]{{1,19}}[A-Z]){{1,6}}|[A-Z]{{1,20}}|[0-9]{{1,8}}|[0-9]{{1,4}}[A-Za-z]{{1,12}}"
#: Classes, the first whose pattern the whole candidate matches counts: its characters and the bits of entropy that a window must reach.
CLASSES = [
    ("[0-9a-f]+|[0-9A-F]+", "0123456789abcdefABCDEF", 3.05),
    ("[A-Za-z]+", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.95),
    ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 3.6),
    (f"[{RUN}]+", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-", 3.85),
]
#: Candidates that are no secrets.
ALLOWED = "(?i)example|dummy|placeholder|changeme|^[0-9+/=_-]+$"
#: Steps of a window that are walked as one piece; longer candidates are walked in pieces that overlap by a window.
PIECE = 1000
#: Counts in one number, bits of each, and the whole numbers that stand for one bit of c log2 c.
COUNTERS, COUNTER_BITS, UNIT = 12, 5, 10**9
#: Matches whose places are summed together.
GROUP = 256

SPAN = "struct<start:bigint,kind:int,end:bigint>"
NONE = f"array<{SPAN}>"


def places(gaps: Column, hits: Column, kind: int) -> Column:
    """Spans of ``hits`` that alternate with ``gaps`` (one more), in groups so that the work grows with their number."""

    def of(pairs: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(pairs) - 1, F.lit(GROUP)).cast("int")), lambda g: F.slice(pairs, g * GROUP + 1, F.lit(GROUP)))

        def spans(gs: Column) -> Column:
            zero = F.lit(0).cast("long")
            totals = F.transform(gs, lambda g: F.aggregate(g, zero, lambda a, p: a + p["gap"] + p["hit"]))
            begins = F.aggregate(totals, F.array(zero), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

            def within(bs: Column) -> Column:
                return F.flatten(F.transform(gs, lambda g, i: F.aggregate(
                    g, F.struct(F.get(bs, i).alias("at"), F.array().cast(NONE).alias("out")),
                    lambda a, p: F.struct(
                        (a["at"] + p["gap"] + p["hit"]).alias("at"),
                        F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + p["gap"] + p["hit"]).alias("end")))).alias("out")),
                    lambda a: a["out"])))

            return let(begins, within)

        return let(groups, spans)

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).cast("long").alias("gap"), F.length(h).cast("long").alias("hit")))
    return let(pairs, of)


def found(text: Column, pattern: str, kind: int, keep=None, inner=None) -> Column:
    """Spans of all matches of a pattern for which ``keep`` holds; ``inner`` changes a span by its match."""

    def of(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

        def with_hits(h: Column) -> Column:
            spans = places(F.split(t, pattern, -1), h, kind)
            if inner is not None:
                return F.flatten(F.zip_with(spans, h, lambda s, x: inner(s, x)))
            if keep is None:
                return spans
            return F.transform(F.filter(F.zip_with(spans, h, lambda s, x: F.struct(s.alias("s"), keep(x).alias("ok"))), lambda z: z["ok"]), lambda z: z["s"])

        return F.when(F.rlike(t, F.lit(pattern)), let(hits, with_hits)).otherwise(F.array().cast(NONE))

    return let(text, of)


def class_facts(kind: Column) -> Column:
    """What a walk needs of the class: its alphabet, how many numbers hold its counts, and the largest sum of a hot window."""
    # entropy of a window is log2(WINDOW) - sum / WINDOW
    return F.get(F.array(*[F.struct(
        F.lit(alphabet).alias("alphabet"), F.lit(-(-len(alphabet) // COUNTERS)).alias("numbers"), F.lit(math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)).cast("long").alias("most"))
        for _, alphabet, bits in CLASSES]), kind)


def hot_windows(piece: Column, facts: Column) -> Column:
    """First and last end (from 1) of windows of ``piece`` that are hot for the class; -1 without one."""
    clogc = F.array(*[F.lit(0 if c < 2 else round(c * math.log2(c) * UNIT)).cast("long") for c in range(WINDOW + 2)])
    one, mask = F.lit(1).cast("long"), F.lit((1 << COUNTER_BITS) - 1).cast("long")

    def count(n: Column, at: Column) -> Column:
        return F.call_function("shiftright", F.get(n, at["number"]), at["bit"]).bitwiseAND(mask).cast("int")

    def added(n: Column, at: Column, sign: int) -> Column:
        return F.transform(n, lambda x, k: F.when(k == at["number"], x + sign * F.call_function("shiftleft", one, at["bit"])).otherwise(x))

    def entered(a: Column, x: Column, n: Column, s: Column) -> Column:
        return let(count(n, x["in"]), lambda c: let(s + F.get(clogc, c + 1) - F.get(clogc, c), lambda now: noted(a, now, added(n, x["in"], 1))))

    def left(a: Column, x: Column) -> Column:
        return let(count(a["n"], x["out"]), lambda c: let(F.struct(added(a["n"], x["out"], -1).alias("n"), (a["s"] - F.get(clogc, c) + F.get(clogc, c - 1)).alias("s")), lambda b: entered(a, x, b["n"], b["s"])))

    def noted(a: Column, s: Column, n: Column) -> Column:
        i = a["i"] + 1
        hot = (i >= WINDOW) & (s <= facts["most"])
        return F.struct(i.alias("i"), s.alias("s"), n.alias("n"), F.when(hot & (a["first"] < 0), i).otherwise(a["first"]).alias("first"), F.when(hot, i).otherwise(a["last"]).alias("last"))

    def walk(codes: Column) -> Column:
        # every character beside the one that leaves the window as it enters
        gone = F.concat(F.array_repeat(F.lit(None).cast("struct<number:int,bit:int>"), WINDOW), F.slice(codes, F.lit(1), F.greatest(F.size(codes) - WINDOW, F.lit(0))))
        steps = F.zip_with(codes, F.slice(gone, F.lit(1), F.size(codes)), lambda c, o: F.struct(c.alias("in"), o.alias("out")))
        start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("s"), F.array_repeat(F.lit(0).cast("long"), facts["numbers"]).alias("n"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(steps, start, lambda a, x: F.when(x["out"].isNotNull(), left(a, x)).otherwise(entered(a, x, a["n"], a["s"])), lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    places = F.transform(F.split(piece, ""), lambda c: let(F.call_function("instr", facts["alphabet"], c) - 1, lambda i: F.struct(F.call_function("div", i, F.lit(COUNTERS)).cast("int").alias("number"), (i % COUNTERS * COUNTER_BITS).cast("int").alias("bit"))))
    return let(places, walk)


def hot_stretch(core: Column, facts: Column) -> Column:
    """Start (from 0) and end of the stretch from the first hot window of ``core`` to its last; null without one."""

    def of(strides: Column) -> Column:
        # a piece is a stride and what a window needs of the next one
        pieces = F.zip_with(strides, F.slice(strides, F.lit(2), F.size(strides)), lambda a, b: F.concat(a, F.substring(F.coalesce(b, F.lit("")), 1, WINDOW - 1)))
        hot = F.filter(F.transform(pieces, lambda p, i: let(hot_windows(p, facts), lambda h: F.when(h["first"] > 0, F.struct((i * PIECE + h["first"] - WINDOW).alias("from"), (i * PIECE + h["last"]).alias("to"))))), lambda x: x.isNotNull())
        return let(hot, lambda h: F.when(F.size(h) > 0, F.struct(F.get(h, F.lit(0))["from"].alias("from"), F.element_at(h, -1)["to"].alias("to"))))

    return let(F.regexp_extract_all(core, F.lit(f".{{1,{PIECE}}}+"), F.lit(0)), of)


def entropy_spans(span: Column, run: Column) -> Column:
    """The stretch of a candidate from its first to its last hot window, as an array of one span or none."""
    none = F.array().cast(NONE)

    def of(lead: Column) -> Column:
        rest = F.substring(run, lead + 1, F.length(run))
        back = F.length(F.regexp_extract(F.reverse(rest), f"^{DELIMITERS}*+(?:(?:{WORD_BACK}){DELIMITERS}++)*+", 0))
        core = let(rest, lambda r: let(back, lambda n: F.substring(r, F.lit(1), F.length(r) - n)))
        return let(core, lambda c: found_in(lead, c))

    def found_in(lead: Column, core: Column) -> Column:
        kind = F.when((F.length(core) < WINDOW) | F.rlike(core, F.lit(ALLOWED)) | F.rlike(core, F.lit(f"^(?:{WORD})$")), F.lit(-1))
        for i, (pattern, *_) in enumerate(CLASSES):
            kind = kind.when(F.rlike(core, F.lit(f"^(?:{pattern})$")), F.lit(i))

        def stretch(k: Column) -> Column:
            hot = F.when(k >= 0, let(class_facts(k), lambda facts: hot_stretch(core, facts)))
            return let(hot, lambda h: F.when(h.isNotNull(), F.array(F.struct((span["start"] + lead + h["from"]).alias("start"), span["kind"].alias("kind"), (span["start"] + lead + h["to"]).alias("end")))).otherwise(none))

        return let(kind, stretch)

    return let(F.length(F.regexp_extract(run, f"^{DELIMITERS}*+(?:(?:{WORD}){DELIMITERS}++)*+", 0)), of)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])), ",")


def scan(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_assign, _access, _hex, _entropy``: arrays of spans in code points."""
    t = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda x: F.length(F.regexp_extract(x, ASSIGN, 1)) >= 8
    return df.select(
        "*", found(t, ASSIGN, 0, keep=long_enough).alias("_assign"),
        F.when(F.contains(t, F.lit("AKIA")), found(t, ACCESS, 1)).otherwise(F.array().cast(NONE)).alias("_access"),
        found(t, HEX, 2).alias("_hex"), found(t, CANDIDATE, 3, inner=entropy_spans).alias("_entropy"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document.

    Null text counts as empty and has no spans; very long texts are scanned whole;
    equal ids and repeated rows are scanned each; spans of several kinds may
    overlap or tie and all stay; an empty table gives none; further columns don't matter.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    spans = scan(docs, "text").select(
        "doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"),
        F.array_sort(F.concat("_assign", "_access", "_hex")).alias("base"), "_entropy")
    return spans.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "_entropy"))).alias("spans"))


_CLASS_SQL = " ".join(f"WHEN regexp_full_match(hit, '{p}') THEN {bits}::DOUBLE" for p, _, bits in CLASSES)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, name, pat) AS (VALUES
  (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'entropy', '[A-Za-z0-9+/=_-]+')),
r AS (
  SELECT rid, kind, name, t, CASE kind WHEN 0 THEN string_split_regex(t, (SELECT pat FROM k WHERE kind = 0)) WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+') WHEN 2 THEN string_split_regex(t, '[0-9a-f]+') ELSE string_split_regex(t, '[A-Za-z0-9+/=_-]+') END AS gaps,
         CASE kind WHEN 0 THEN regexp_extract_all(t, (SELECT pat FROM k WHERE kind = 0)) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]+') ELSE regexp_extract_all(t, '[A-Za-z0-9+/=_-]+') END AS hits FROM d, k
), u AS (
  SELECT rid, kind, name, i, hits[i] AS hit, length(gaps[i]) AS g, length(hits[i]) AS n FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM r)
), s AS (
  SELECT rid, kind, name, hit, sum(g + n) OVER (PARTITION BY rid, kind ORDER BY i)::BIGINT - n AS a, n FROM u
), base AS (
  SELECT rid, kind, name, a, a + n AS b FROM s
  WHERE kind = 0 AND length(regexp_extract(hit, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8 OR kind = 1 AND n >= 16 OR kind = 2 AND n >= 32
), c0 AS (
  SELECT rid, a + len(hit) - len(rest) AS a, rest FROM (SELECT *, regexp_replace(hit, '^{DELIMITERS}*(?:(?:{WORD}){DELIMITERS}+)*', '') AS rest FROM s WHERE kind = 3 AND n >= 24)
), c1 AS (
  SELECT rid, a, rest[1:len(rest) - len(reverse(rest)) + len(regexp_replace(reverse(rest), '^{DELIMITERS}*(?:(?:{WORD_BACK}){DELIMITERS}+)*', ''))] AS hit FROM c0
), c AS (
  SELECT rid, a, hit, len(hit) AS n, CASE {_CLASS_SQL} END AS least FROM c1 WHERE len(hit) >= 24 AND NOT regexp_matches(hit, '{ALLOWED}') AND NOT regexp_full_match(hit, '{WORD}')
), x AS (
  SELECT rid, a, p, least, entropy(ch) AS e FROM (SELECT rid, a, p, least, unnest(string_split(hit[p + 1:p + 24], '')) AS ch FROM (SELECT *, unnest(range(n - 23)) AS p FROM c)) GROUP BY ALL
), e AS (
  SELECT rid, 3 AS kind, 'entropy' AS name, a + min(p) AS a, a + max(p) + 24 AS b FROM x WHERE e >= least GROUP BY rid, a, least
), al AS (
  SELECT rid, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM e) GROUP BY rid
), ba AS (
  SELECT rid, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2 FROM base GROUP BY rid
)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(ba.spans, '')) AS base_sha256, coalesce(al.spans, '') AS spans
FROM d LEFT JOIN ba USING (rid) LEFT JOIN al USING (rid)
"""
