"""Quality rules with risk-controlled thresholds.

Each rule is a score of a text; a document goes if a score exceeds the rule's cutoff in the
document's stratum.  Cutoffs come from labelled documents:

* The labelled rows are dealt by a hash of the id into a fit part and a holdout part.
* In each stratum, with ``n`` good holdout documents, ``k`` is the largest number such that
  P[Binomial(n, alpha / rules) <= k] <= delta / (rules * strata): an exact binomial (Clopper-Pearson)
  bound with Bonferroni's correction over all rules and strata.  Any cutoff that rejects at
  most ``k`` good holdout documents therefore rejects at most a share ``alpha / rules`` of all good documents of the
  stratum, and all rules together at most ``alpha``, with confidence 1 - delta.  The cutoffs of a rule are nested, so
  the certified ones are those above one point, which takes no further correction.
* Among the certified cutoffs the fit part picks: gain = rejected bad documents - ``penalty`` x rejected
  good ones; the loosest cutoff with ``share`` of the best gain is taken.  Without a positive gain, or with too few labels to
  certify anything, the rule is off in that stratum.

Scores are whole numbers from 0 to 10,000, so the cutoffs come from counts per (stratum, rule, score): labelled rows
meet in partial aggregates only, and no window sees more than 10,001 rows.  All of it is
DataFrame expressions: a text is split once per row, no text is shuffled.

Defined results: a null text has no words and fails the base rule.  A null stratum is a stratum of its own.  Labels
without a document, null labels and null ids are ignored; for a repeated label the lowest counts.  With empty
tables every rule is off.  Extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwright.llm.common import WHITE, let, settle, sheltered, text_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RULES = ("symbols", "stutter", "dup_lines", "repeats", "long_words")
TOP = 10_000


def _repeat_words(words: Column) -> Column:
    """Words inside windows of 8 that occur at least twice; sorts only where some window does."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"])
            return F.sort_array(F.array_compact(F.transform(s, lambda e, j: F.when(same(e, j), e["i"]))))

        def union(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        repeated = let(let(ordered, starts), union)
        return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0).cast("long")).otherwise(repeated)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


def features(text: Column) -> Column:
    """Struct of a text's counts."""
    has_word = lambda line: F.length(F.btrim(line, F.lit(WHITE))) > 0
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_stutter"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        let(words, of_words).alias("w"),
        let(F.filter(F.split(text, "\n"), has_word), of_lines).alias("l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )


def with_features(docs: DataFrame, text_col: str = "text", stratum_col: str | None = "lang", prefix: str = "") -> DataFrame:
    """``docs`` with the counts, the scores and the base verdict in columns ``prefix`` + name."""
    p, f = prefix, f"{prefix}features"
    part = lambda a, b: F.coalesce(F.floor(F.try_divide(F.col(p + a) * TOP, F.col(p + b))), F.lit(0))
    df = docs.withColumn(f, features(text_of(docs, text_col)))
    df = df.withColumns(
        {p + n: F.col(f)["w"][n] for n in ("n_words", "word_chars", "n_repeat_words", "n_stutter")}
        | {p + n: F.col(f)["l"][n] for n in ("n_lines", "n_dup_lines")}
        | {
            f"{p}n_symbols": F.col(f)["n_symbols"],
            f"{p}stratum": F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit(""),
        }
    ).drop(f)
    n, rep = F.col(f"{p}n_words"), F.col(f"{p}n_repeat_words")
    scores = {
        "symbols": part("n_symbols", "word_chars"),
        "stutter": part("n_stutter", "n_words"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "long_words": F.coalesce(F.floor(F.try_divide(F.col(f"{p}word_chars") * 100, n)), F.lit(0)),
    }
    return df.withColumns(
        {f"{p}s_{r}": F.least(F.lit(TOP), s).cast("int") for r, s in scores.items()}
        | {f"{p}base_failed": (n < MIN_WORDS) | (rep * 100 > n * MAX_REPEAT_PERCENT)}
    )


def allowed_rejections(n: Column, rate: Column, risk: Column) -> Column:
    """Largest k with P[Binomial(n, rate) <= k] <= risk, or -1: the exact bound, summed term by term."""
    start = F.struct(
        (n * F.log1p(-rate)).alias("lp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k")
    )

    def step(s: Column, i: Column) -> Column:
        cdf = s["cdf"] + F.exp(s["lp"])
        ratio = (n - i) / (i + 1) * rate / (1 - rate)
        nxt = F.when(ratio > 0, s["lp"] + F.ln(ratio)).otherwise(F.lit(-1e300))
        return F.struct(nxt.alias("lp"), cdf.alias("cdf"), F.when(cdf <= risk, i.cast("long")).otherwise(s["k"]).alias("k"))

    upto = F.least(n, F.ceil(n * rate)).cast("long")
    return F.aggregate(F.sequence(F.lit(0).cast("long"), upto), start, step, lambda s: s["k"])


def fit_cutoffs(
    rows: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    prefix: str = "",
    alpha: float = 0.02,
    delta: float = 0.05,
    penalty: float = 20.0,
    share: float = 0.95,
    holdout: float = 0.75,
) -> DataFrame:
    """One row per stratum: stratum and a map rule -> cutoff of the rules that are on."""
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    good = good.agg((F.min(label_col) > 0).alias("_good"))
    scores = F.map_from_arrays(
        F.array(*[F.lit(r) for r in RULES]), F.array(*[F.col(f"{prefix}s_{r}") for r in RULES])
    )
    labelled = rows.where(~F.col(f"{prefix}base_failed")).select(
        F.col(id_col).alias("_id"), F.col(f"{prefix}stratum").alias("stratum"), scores.alias("scores")
    )
    held = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1000)) < int(1000 * holdout)
    points = labelled.join(good, "_id").select("stratum", "_good", held.alias("held"), F.explode("scores").alias("rule", "score"))
    sums = lambda c: F.sum(F.when(c, 1).otherwise(0))
    bins = points.groupBy("stratum", "rule", "score").agg(
        sums(F.col("held") & F.col("_good")).alias("hold_good"),
        sums(~F.col("held") & F.col("_good")).alias("fit_good"),
        sums(~F.col("held") & ~F.col("_good")).alias("fit_bad"),
    )
    bins = settle(bins, "score-bins")
    strata = max(1, bins.select(F.count_distinct("stratum")).first()[0])
    of_rule = Window.partitionBy("stratum", "rule")
    above = of_rule.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    gain = F.coalesce(F.sum(F.col("fit_bad") - penalty * F.col("fit_good")).over(above), F.lit(0.0))
    cut = bins.select(
        "stratum",
        "rule",
        "score",
        gain.alias("gain"),
        F.coalesce(F.sum("hold_good").over(above), F.lit(0)).alias("rejected"),
        F.sum("hold_good").over(of_rule).alias("n"),
    )
    bound = allowed_rejections(F.col("n"), F.lit(alpha / len(RULES)), F.lit(delta / len(RULES) / strata))
    sizes = cut.groupBy("stratum", "rule").agg(F.max("n").alias("n")).withColumn("allowed", bound).drop("n")
    cut = cut.join(sizes, ["stratum", "rule"]).where("rejected <= allowed and gain > 0")
    best = cut.groupBy("stratum", "rule").agg(F.max("gain").alias("best"))
    chosen = cut.join(best, ["stratum", "rule"]).where(F.col("gain") >= share * F.col("best"))
    chosen = chosen.groupBy("stratum", "rule").agg(F.max("score").alias("cutoff"))
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "cutoff")))).alias("cutoffs"))


def judge(rows: DataFrame, cutoffs: DataFrame, prefix: str = "") -> DataFrame:
    """``rows`` with ``prefix`` + failed_rules (array) and kept.  Cutoffs have one row per stratum and are written before the join."""
    p = prefix
    cutoffs = settle(cutoffs.select(F.col("stratum").alias(f"{p}stratum"), F.col("cutoffs").alias(f"{p}cutoffs")), "cutoffs")
    failed = F.array_compact(F.array(*[F.when(F.col(f"{p}s_{r}") > F.element_at(f"{p}cutoffs", F.lit(r)), F.lit(r)) for r in RULES]))
    out = rows.drop(f"{p}cutoffs").join(cutoffs, f"{p}stratum", "left").withColumn(f"{p}failed_rules", F.coalesce(failed, F.array().cast("array<string>")))
    return out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.size(f"{p}failed_rules") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", stratum_col: str | None = "lang", **fit) -> DataFrame:
    """The rows of ``docs`` that pass.  Counts are taken once, beside the text, so no text is shuffled."""
    p = "_quality_"
    packed, back = sheltered(docs, fit.get("id_col", "doc_id"), text_col, stratum_col)
    rows = settle(with_features(packed, text_col, stratum_col, p), "quality-rows")
    return back(judge(rows, fit_cutoffs(rows, labels, prefix=p, **fit), p).where(f"{p}kept"))
