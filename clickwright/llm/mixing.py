"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights: source s with token share q_s gets weight p_s = q_s^tau / sum(q^tau).  tau = 1 is the natural mix and tau = 0 the
uniform one.  tau is found by bisection: the largest tau whose entropy reaches the target, raised as far as
the repetition limit asks (the limit wins).  Each step cuts the interval in 16 by one aggregate over the per-source table,
so sources never come to the driver, however many there are.

Tokens: ids of a public tokenizer (``tokenizer``, the path of its file) and the end id, or a column that holds them
(``tokens_col``).  With neither, words between white space count, which gives a text in a script without spaces next to no weight.

Budget: source s may emit p_s x budget tokens.  Without a budget it is set so that the source that is repeated least is
emitted exactly once; no document is then lost and the others repeat at most ``max_repeats`` times.

Realisation: documents are hashed into blocks of about ``block_tokens`` tokens (at most ``MAX_BLOCKS`` a source).  A pass over a
source is a permutation of its blocks.  Whole passes emit all blocks; the last pass emits blocks in permuted
order until the budget is met, and only the block on the edge is cut, inside, in its own order, to the nearest document.  So no sort or
window is wider than one block's documents or one source's blocks: a source with a third of all rows is as spread as any other.

Defined results: a null source counts as the empty source, and an empty or null text as one token; so does a null, zero or negative number in ``tokens_col``.  Null ids and repeated rows
are documents like any other.  An empty table gives an empty mix.  Extra columns are carried, also if they share a name with the plan's.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwright.llm.common import WHITE, settle, sheltered, ship, text_of
from clickwright.llm.tokens import counted

MAX_BLOCKS = 65_536
SECTIONS = 16
STEPS = 8


@dataclass
class Mix:
    """tau, and the tables that realise it (all written): sources, blocks (source, block), edge (ids of the cut blocks that stay)."""

    tau: float
    sources: DataFrame
    blocks: DataFrame
    edge: DataFrame


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.greatest(F.lit(1), F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))).cast("long")


def token_count(text: Column, tokenizer: str) -> Column:
    """Ids of a text without nulls, and the end id."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([n + 1 for n in counted(tokenizer, texts.to_pylist())], pa.int64())

    return count(text)


def measured(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 7,
    tokenizer: str | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """``docs`` with _mix_source, _mix_tokens and _mix_hash, which deals documents into blocks and orders them there."""
    named = F.coalesce(F.concat(F.lit("i"), docs[id_col].cast("string")), F.lit("null"))
    text = text_of(docs, text_col)
    if tokens_col is not None:
        tokens = F.greatest(F.lit(1).cast("long"), docs[tokens_col].cast("long"))
    elif tokenizer is not None:
        ship(docs.sparkSession)
        tokens = token_count(text, tokenizer)
    else:
        tokens = word_count(text)
    return docs.withColumns(
        {
            "_mix_source": F.coalesce(docs[source_col].cast("string"), F.lit("")),
            "_mix_tokens": tokens,
            "_mix_hash": F.xxhash64(named, text, F.lit(seed)),
        }
    )


def find_tau(sources: DataFrame, target_entropy: float | None, max_repeats: float, budget: float | None) -> float:
    """Bisect tau on the table (source, tokens, share).  ``target_entropy`` is a share of the highest, ln(number of sources)."""

    def section(lo: float, hi: float, ok) -> tuple[float, float]:
        taus = [lo + (hi - lo) * i / SECTIONS for i in range(1, SECTIONS)]
        verdict = sources.select(*[ok(t).alias(f"t{i}") for i, t in enumerate(taus)]).first()
        passed = [t for t, v in zip(taus, verdict) if v]
        first = min(passed, default=hi)
        return max([t for t in taus if t < first], default=lo), first

    def entropy_short(t: float) -> Column:  # true once the entropy at t is below the target; monotone in t
        w = F.pow("share", F.lit(t))
        h = F.ln(F.sum(w)) - F.sum(w * F.ln(w)) / F.sum(w)
        return h < F.lit(target_entropy) * F.ln(F.count(F.lit(1)))

    def repeats_fit(t: float) -> Column:  # true once the most repeated source keeps the limit; monotone in t
        passes = F.pow("share", F.lit(t - 1))
        scale = F.min(passes) if budget is None else F.sum(F.pow("share", F.lit(t))) * F.sum("tokens") / F.lit(float(budget))
        return F.max(passes) / scale <= F.lit(max_repeats) * (1 + 1e-9)

    lo, hi = 0.0, 1.0
    if target_entropy is not None:
        for _ in range(STEPS):
            lo, hi = section(lo, hi, entropy_short)
    else:
        hi = lo
    tau = lo
    if not sources.select(repeats_fit(tau)).first()[0]:
        lo, hi = tau, 1.0
        for _ in range(STEPS):
            lo, hi = section(lo, hi, repeats_fit)
        tau = hi
    return tau


def plan_mix(
    rows: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float = 4.0,
    budget: float | None = None,
    block_tokens: int = 65_536,
    seed: int = 7,
) -> Mix:
    """The plan for ``rows`` (from ``measured``)."""
    per = rows.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("_mix_tokens").alias("tokens"))
    per = settle(per, "mix-totals")
    total = per.agg(F.sum("tokens")).first()[0]
    per = settle(per.withColumn("share", F.col("tokens") / F.lit(total or 1)), "mix-shares")
    tau = find_tau(per, target_entropy, max_repeats, budget) if not per.isEmpty() else 1.0
    power = per.withColumn("w", F.pow("share", F.lit(tau)))
    z, least = power.agg(F.sum("w"), F.min(F.col("w") / F.col("share"))).first()
    z, least = F.lit(z or 1.0), F.lit(least or 1.0)
    passes = F.col("w") / F.col("share") / least
    if budget is not None:
        passes = F.lit(float(budget)) * F.col("w") / z / F.col("tokens")
    power = power.withColumn("weight", F.col("w") / z).withColumn("passes", F.least(F.lit(float(max_repeats)), passes))
    power = power.withColumn("whole", F.floor(F.col("passes") + 1e-9).cast("long"))
    rest = F.round(F.greatest(F.lit(0.0), F.col("passes") - F.col("whole")) * F.col("tokens")).cast("long")
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / block_tokens)).cast("int")
    sources = power.select("source", "tokens", "share", "weight", "passes", "whole", rest.alias("rest"), blocks.alias("n_blocks"))
    sources = settle(sources, "mix-sources")

    dealt = _dealt(rows, sources)
    sizes = dealt.groupBy("source", "block").agg(F.sum("_mix_tokens").alias("size")).join(sources, "source")
    turn = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", "whole", F.lit(seed)), "block")
    before = F.coalesce(F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.select("source", "block", "size", "whole", "weight", (F.col("rest") - before).alias("room"))
    last = F.when(F.col("room") >= F.col("size"), "all").when(F.col("room") > 0, "edge").otherwise("none")
    table = settle(room.withColumn("last", last), "mix-blocks")

    own = Window.partitionBy("source", "block").orderBy("_mix_hash").rowsBetween(Window.unboundedPreceding, -1)
    cut = dealt.join(table.where("last = 'edge'").select("source", "block", "room"), ["source", "block"])
    cut = cut.groupBy("source", "block", "_mix_hash").agg(F.sum("_mix_tokens").alias("_mix_tokens"), F.first("room").alias("room"))
    cut = cut.where(F.col("room") >= 1).withColumn("before", F.coalesce(F.sum("_mix_tokens").over(own), F.lit(0)))
    edge = settle(cut.where("2 * (room - before) >= _mix_tokens").select("source", "_mix_hash"), "mix-edge")
    return Mix(tau, sources, table, edge)


def _dealt(rows: DataFrame, sources: DataFrame) -> DataFrame:
    small = sources.select("source", "n_blocks")
    own = rows.select(F.col("_mix_source").alias("source"), "_mix_tokens", "_mix_hash").join(small, "source")
    return own.withColumn("block", F.pmod("_mix_hash", "n_blocks").cast("int"))


def emit(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row per emitted copy: the columns of ``rows`` and _mix_block, _mix_weight, _mix_pass."""
    names = {"source": "_mix_source"}
    per = mix.sources.select("source", "n_blocks").withColumnsRenamed(names | {"n_blocks": "_mix_n"})
    table = mix.blocks.select("source", "block", "whole", "weight", "last").withColumnsRenamed(
        names | {"block": "_mix_block", "whole": "_mix_whole", "weight": "_mix_weight", "last": "_mix_last"}
    )
    edge = mix.edge.select("source", "_mix_hash").withColumnsRenamed(names).withColumn("_mix_in", F.lit(True))
    out = rows.join(per, "_mix_source").withColumn("_mix_block", F.pmod("_mix_hash", "_mix_n").cast("int"))
    out = out.join(table, ["_mix_source", "_mix_block"]).join(edge, ["_mix_source", "_mix_hash"], "left")
    extra = (F.col("_mix_last") == "all") | ((F.col("_mix_last") == "edge") & F.col("_mix_in").isNotNull())
    copies = F.col("_mix_whole") + F.when(extra, 1).otherwise(0)
    out = out.withColumn("_mix_copies", copies).where("_mix_copies > 0")
    out = out.withColumn("_mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_copies") - 1)))
    return out.drop("_mix_n", "_mix_whole", "_mix_last", "_mix_in", "_mix_copies")


def in_order(emitted: DataFrame, mix: Mix, seed: int = 7) -> DataFrame:
    """Add _mix_turn: where the block of a copy stands among all blocks its source emits, from 0 to 1.

    Sorting by (_mix_turn, _mix_source, _mix_pass, _mix_hash) interleaves the sources evenly.
    """
    last = F.col("whole") + F.when(F.col("last") != "none", 1).otherwise(0)
    turns = mix.blocks.where(last > 0).select("source", "block", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)).alias("pass"))
    per = Window.partitionBy("source")
    rank = F.row_number().over(per.orderBy("pass", F.xxhash64("source", "block", "pass", F.lit(seed)), "block"))
    turns = turns.withColumn("turn", (rank - 0.5) / F.count(F.lit(1)).over(per))
    turns = settle(turns.withColumnsRenamed({c: f"_mix_{c}" for c in turns.columns}), "mix-turns")
    return emitted.join(turns, ["_mix_source", "_mix_block", "_mix_pass"])


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    tokenizer: str | None = None,
    tokens_col: str | None = None,
    **how,
) -> DataFrame:
    """The rows of ``docs`` (all columns), each as often as the mix emits it.  The plan is small; the text is not shuffled for it."""
    packed, back = sheltered(docs, id_col, source_col, text_col, tokens_col)
    rows = measured(packed, id_col, source_col, text_col, tokenizer=tokenizer, tokens_col=tokens_col)
    slim = settle(rows.select("_mix_source", "_mix_tokens", "_mix_hash"), "mix-rows")
    return back(emit(rows.drop("_mix_tokens"), plan_mix(slim, **how)))
