"""Quality rules with adaptive thresholds, native DataFrame operations only.

Every metric of a document is held against a fence made from the quartiles of its own language and
source: ``q50 + WIDTH * max(q75 - q50, q50 - q25, spread)``, and the mirrored lower fence where a
metric has one. ``spread`` is the least distance that counts as spread; without it a group whose
quartiles agree (no symbols in three of four texts) would reject any text that differs.

Quartiles come from mergeable sketches: counts of values in logarithmic bins (a relative error of
half of ``BIN`` - 1 at most, zero in a bin of its own). Counts are integers and are only added, so
a sketch, and with it every fence, is the same however the rows are partitioned. Sketches by
language and source add up to those by language and to the one of all documents. The quartiles of
a language and source are drawn to those of its language, and these to those of all documents, with
the weight of ``PRIOR`` documents: a group of two texts is judged almost as its language, one of a
million by itself, and the same rule holds at every size. The thresholds are joined to the
documents; a hot source is one row of that table and many rows of documents, which the adaptive
skew join splits.

Repeated 8-word windows are found inside each row: word hashes are combined into window hashes by
three doublings, and only a text in which two windows agree is looked at position by position, by
sorting (window text, position) and comparing neighbours: exact, and n log n for any length.

Cases: null text has no words and fails the base rule; null language or source is a group of its
own; repeated rows each get a row; ``quality_filter`` drops rows, not ids (a row goes by its id, its
text and its group, null or not); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_RUN, materialize, text_or_empty

#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

WIDTH = 3.0
#: Documents that a group's parent counts for.
PRIOR = 50
#: Ratio of the bounds of a bin.
BIN = 1.01
#: metric: (least spread, has a lower fence)
METRICS = {
    "symbol_ratio": (0.02, False),
    "upper_ratio": (0.05, False),
    "dup_line_ratio": (0.15, False),
    "repeat_ratio": (0.1, False),
    "stutter_ratio": (0.05, False),
    "mean_word_chars": (1.5, True),
}


def _doubled(h: str, step: int):
    """Hashes of runs twice as long: of positions i and i + step."""
    return F.expr(
        f"if(size({h}) > {step}, zip_with(slice({h}, 1, size({h}) - {step}), "
        f"slice({h}, {step + 1}, size({h}) - {step}), (a, b) -> xxhash64(a, b)), array())"
    )


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=("lang", "source"), *more: str) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, what the
    metrics need besides, and the columns ``more`` as they are."""
    ws = F.lit(WS_CHARS)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(group_cols[0]).cast("string").alias("lang"),
        F.col(group_cols[1]).cast("string").alias("source"),
        text_or_empty(text_col).alias("t"), *more,
    )
    rows = rows.select(
        "doc_id", "lang", "source", *more,
        F.length(F.translate("t", WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.expr(
            r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"
        ).alias("lines"),
        F.split(F.btrim("t", ws), WS_RUN).alias("w"),
    ).withColumn("w", F.expr("if(word_chars = 0, array(), w)"))
    rows = rows.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h1"),
    ).drop("lines")
    rows = rows.withColumn("h2", _doubled("h1", 1)).withColumn("h4", _doubled("h2", 2)).withColumn("h8", _doubled("h4", 4))
    # Positions whose window agrees with a neighbour once (window, position) is sorted.
    positions = f"""
      transform(array(sort_array(transform(h8, (h, i) ->
          struct(array_join(slice(w, i + 1, {WINDOW}), ' ') as x, i as i)))), s ->
        transform(array(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1),
            (a, b) -> a.x = b.x)), e ->
          sort_array(transform(filter(zip_with(s, zip_with(array_append(e, false),
              array_prepend(e, false), (a, b) -> a or b), (p, f) -> struct(p.i as i, f as f)),
            q -> q.f), q -> q.i)))[0])[0]"""
    covered = f"""
      if(size(h8) = size(array_distinct(h8)), 0L,
        coalesce(transform(array({positions}), p -> if(size(p) = 0, 0L,
          aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1),
            (a, b) -> least({WINDOW}, b - a)), {WINDOW}L, (acc, x) -> acc + x)))[0], 0L))"""
    stutter = "size(filter(zip_with(h1, slice(h1, 2, greatest(size(h1) - 1, 0)), (a, b) -> a <=> b), x -> x))"
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines",
        F.expr(stutter).cast("long").alias("n_stutters"),  # words equal to the word before
        F.expr(covered).cast("long").alias("n_repeat_words"), *more,
    )


def _ratios(rows: DataFrame) -> DataFrame:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.withColumns({
        "symbol_ratio": per("n_symbols", "word_chars"),
        "upper_ratio": per("n_upper", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "stutter_ratio": per("n_stutters", "n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def _bin(value: Column) -> Column:
    """The number of the bin: 0 for zero, else that of BIN ** (i - 1) < value <= BIN ** i, moved
    above 0. Values are 0 or ratios of counts below 2 ** 40."""
    shift = math.ceil(40 * math.log(2) / math.log(BIN))
    return F.when(value <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log(value) / math.log(BIN)) + shift)).cast("int")


def _bin_value(number: Column) -> Column:
    shift = math.ceil(40 * math.log(2) / math.log(BIN))
    return F.when(number == 0, 0.0).otherwise(F.pow(F.lit(BIN), number - shift) * (2 / (1 + BIN)))


QUARTILES = (25, 50, 75)


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: the sketch of each group, at most some thousand bins each.
    Partial counts are combined before the shuffle."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), _bin(F.col(m)).alias("bin")) for m in METRICS])
    return rows.select("lang", "source", F.inline(values)).groupBy("lang", "source", "metric", "bin").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """by, metric, {prefix}n, {prefix}25, ..: nearest-rank quartiles of merged sketches. A window
    holds the bins of one metric of one group."""
    merged = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*by, "metric")
    below = merged.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("total", F.sum("n").over(part))
    at = lambda p: _bin_value(F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bin"))))
    return below.groupBy(*by, "metric").agg(F.max("total").alias(f"{prefix}n"), *[at(p).alias(f"{prefix}{p}") for p in QUARTILES])


def _drawn(n: str, own: str, parent: Column) -> Column:
    return (F.col(n) * F.col(own) + PRIOR * parent) / (F.col(n) + PRIOR)


def adaptive_thresholds(rows: DataFrame) -> DataFrame:
    """lang, source, group_docs and the fences lo_metric and hi_metric."""
    fine = materialize(sketches(rows), "quality-sketches")
    own = _quartiles(fine, ["lang", "source"], "g")
    by_lang = _quartiles(fine, ["lang"], "l").withColumnsRenamed({"lang": "l", "metric": "lm"})
    by_all = _quartiles(fine, [], "a").withColumnRenamed("metric", "am")
    held = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("lm")))
    held = held.join(F.broadcast(by_all), F.col("metric") == F.col("am"))  # a row a metric
    q = {p: _drawn("gn", f"g{p}", _drawn("ln", f"l{p}", F.col(f"a{p}"))) for p in QUARTILES}
    held = held.select("lang", "source", "metric", "gn", *[q[p].alias(f"q{p}") for p in QUARTILES])
    spread = F.element_at(F.create_map(*[F.lit(x) for m, (s, _) in METRICS.items() for x in (m, s)]), F.col("metric"))
    width = WIDTH * F.greatest(F.col("q75") - F.col("q50"), F.col("q50") - F.col("q25"), spread)
    held = held.withColumn("hi", F.col("q50") + width).withColumn("lo", F.col("q50") - width)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    fences = [pick(m, "hi").alias(f"hi_{m}") for m in METRICS]
    fences += [(pick(m, "lo") if low else F.lit(float("-inf"))).alias(f"lo_{m}") for m, (_, low) in METRICS.items()]
    return held.groupBy("lang", "source").agg(F.max("gn").alias("group_docs"), *fences)


def _row_key(id_col: str, text_col: str, group_cols) -> Column:
    """A digest of what a verdict depends on, and of the id."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.hex(F.col(c).cast("string"))), F.lit("-"))
    return F.sha2(F.concat_ws(",", *[part(c) for c in (id_col, *group_cols)], F.sha2(text_or_empty(text_col), 256)), 256)


def _held(docs: DataFrame, id_col: str, text_col: str, group_cols, *more: str) -> DataFrame:
    rows = materialize(_ratios(base_metrics(docs, id_col, text_col, group_cols, *more)), "quality-metrics")
    limits = adaptive_thresholds(rows).withColumnsRenamed({"lang": "l", "source": "s"})
    held = rows.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    beyond = F.filter(
        F.array(*[
            F.when((F.col(m) > F.col(f"hi_{m}")) | (F.col(m) < F.col(f"lo_{m}")), F.lit(m)) for m in METRICS
        ]),
        lambda x: x.isNotNull(),
    )
    return held.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(beyond) == 0)).alias("kept"),
        F.concat_ws(",", beyond).alias("failed"), *more,
    )


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=("lang", "source")) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed (names of the metrics beyond their fences)."""
    return _held(docs, id_col, text_col, group_cols)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols=("lang", "source")) -> DataFrame:
    """The rows of ``docs`` whose own verdict is kept, in the columns of ``docs``."""
    key = _row_key(id_col, text_col, group_cols)
    gone = _held(docs.select(id_col, text_col, *group_cols, key.alias("row_key")), id_col, text_col, group_cols, "row_key")
    gone = gone.where(~F.col("kept")).select(F.col("row_key").alias("gone_key"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("row_key"))
    return rows.join(gone, F.col("row_key") == F.col("gone_key"), "left_anti").select("row.*")


_RATIOS = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)", "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "stutter_ratio": "n_stutters / greatest(n_words, 1)", "mean_word_chars": "word_chars / greatest(n_words, 1)",
}
_SHIFT = math.ceil(40 * math.log(2) / math.log(BIN))


def _sql_quartiles(name: str, by: str, prefix: str) -> str:
    part = f"PARTITION BY {by}metric"
    at = ", ".join(f"min(bin) FILTER (upto * 100 >= total * {p}) AS {prefix}{p}" for p in QUARTILES)
    value = ", ".join(f"CASE WHEN {prefix}{p} = 0 THEN 0 ELSE pow({BIN}, {prefix}{p} - {_SHIFT}) * {2 / (1 + BIN)!r} END AS {prefix}{p}" for p in QUARTILES)
    return f"""{name}0 AS (SELECT {by}metric, bin, sum(n) AS n FROM sketch GROUP BY {by}metric, bin),
{name}1 AS (SELECT *, sum(n) OVER ({part} ORDER BY bin) AS upto, sum(n) OVER ({part}) AS total FROM {name}0),
{name}2 AS (SELECT {by}metric, max(total)::DOUBLE AS {prefix}n, {at} FROM {name}1 GROUP BY {by}metric),
{name} AS (SELECT {by}metric, {prefix}n, {value} FROM {name}2)"""


def _sql_drawn(p: int) -> str:
    return f"(gn * g{p} + {PRIOR} * ((ln * l{p} + {PRIOR} * a{p}) / (ln + {PRIOR}))) / (gn + {PRIOR}) AS q{p}"


#: DuckDB.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, lang, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars FROM t),
place AS (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM s),
win AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM place),
twice AS (SELECT r, k FROM win GROUP BY r, k HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM win SEMI JOIN twice USING (r, k)),
repeats AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
base AS (SELECT s.r, doc_id, lang, source, len(w)::BIGINT AS n_words, word_chars, n_symbols, n_upper, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters FROM s LEFT JOIN repeats USING (r)),
value AS (SELECT r, lang, source, unnest([{", ".join(f"{{'metric': '{m}', 'x': {e}}}" for m, e in _RATIOS.items())}], recursive := true) FROM base),
sketch AS (SELECT lang, source, metric, CASE WHEN x <= 0 THEN 0 ELSE greatest(1, ceil(ln(x) / {math.log(BIN)!r}) + {_SHIFT}) END AS bin, count(*) AS n
  FROM value GROUP BY lang, source, metric, bin),
{_sql_quartiles("g", "lang, source, ", "g")},
{_sql_quartiles("l", "lang, ", "l")},
{_sql_quartiles("a", "", "a")},
q AS (SELECT g.lang, g.source, metric, {", ".join(map(_sql_drawn, QUARTILES))} FROM g JOIN a USING (metric)
  JOIN l ON l.metric = g.metric AND l.lang IS NOT DISTINCT FROM g.lang),
rule(metric, spread, low) AS (VALUES {", ".join(f"('{m}', {s}, {str(low).lower()})" for m, (s, low) in METRICS.items())}),
fence AS (SELECT lang, source, metric, q50 + {WIDTH} * greatest(q75 - q50, q50 - q25, spread) AS hi,
  CASE WHEN low THEN q50 - {WIDTH} * greatest(q75 - q50, q50 - q25, spread) END AS lo FROM q JOIN rule USING (metric)),
beyond AS (SELECT DISTINCT r FROM value v JOIN fence f ON f.metric = v.metric AND f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source
  WHERE x > hi OR x < lo)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT base_failed AND r NOT IN (SELECT r FROM beyond) AS kept FROM base
"""
