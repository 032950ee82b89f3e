"""Exact deduplication: tree merge of sorted digest runs.

Every row becomes ``(digest, check, bytes, id, seq)`` and belongs to one of ``runs`` runs; ``seq`` is its number in the written table.  Each
task sorts its rows by run and digest and sends one entry per text: best identifier and row count.  Runs then merge in binomial rounds: a round
brings the entries of ``fan_in`` neighbouring runs together, one prefix range of the digests at a time, sorts them there and walks
them in order, so that of equal neighbours only the verified best identifier survives.  After log(runs) / log(fan_in) rounds one
run, sorted in each of its prefix ranges, holds one entry per distinct text.  The way back goes over the
entries of the first level, so a text that fills a third of the table is joined as at most ``runs`` entries
and never as one group of rows.

The best identifier is the maximum of a struct, which Spark can only aggregate over sorted rows (a plan test holds it to that).
Two texts are the same only if their SHA-256, a second 64-bit hash and their byte lengths agree.

Defined results: a null text is the empty text.  Null ids never win against another id.  Among
repeated rows (same id, same text) exactly one is kept.  An empty table gives an empty result.
Columns other than the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwright.llm.common import settle, sheltered, text_of

_TEXT = ["digest", "check", "n_bytes"]


def _digests(text: Column) -> list[Column]:
    return [
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    ]


def digest_rows(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per document: id, digests, its number, and the run that it starts in (rows of any id and text are spread over all)."""
    rows = docs.select(docs[id_col].alias("id"), *_digests(text_of(docs, text_col)), F.monotonically_increasing_id().alias("seq"))
    return settle(rows.withColumn("run", F.pmod(F.xxhash64("seq"), F.lit(runs)).cast("int")), "digest-rows")


def _rank(keep: str) -> Column:
    """What the aggregate compares: a null id is worse than any other; among rows of one id the number decides."""
    there = F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()
    return F.struct(there.alias("there"), "id", "seq")


def merge_runs(level: DataFrame, runs: int, fan_in: int, keep: str) -> DataFrame:
    """Merge runs of (run, prefix, digests, best, size) round by round until one is left."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    while runs > 1:
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition("run", "prefix")
            .groupBy("run", "prefix", *_TEXT)
            .agg(best("best").alias("best"), F.sum("size").alias("size"))
        )
        runs = -(-runs // fan_in)
    return level.drop("run", "prefix")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 512, fan_in: int = 8
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest, n_bytes.

    ``keep``: whether the largest or the smallest id of a group of equal texts stays.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    rows = digest_rows(docs, runs, id_col, text_col)
    entries = rows.withColumns({"prefix": F.substring("digest", 1, 2), "best": _rank(keep)}).groupBy("run", "prefix", *_TEXT)
    first = settle(entries.agg(best("best").alias("best"), F.count(F.lit(1)).alias("size")), "digest-runs")
    merged = merge_runs(first, runs, fan_in, keep)
    merged = merged.select(*_TEXT, F.col("best.id").alias("keep_id"), F.col("best.seq").alias("keep_seq"), F.col("size").alias("group_size"))
    back = first.select("run", *_TEXT).join(merged, _TEXT)
    out = rows.join(back, ["run", *_TEXT])
    return out.select("id", "keep_id", "group_size", (F.col("seq") == F.col("keep_seq")).alias("kept"), "digest", "n_bytes")


def keep_one_per_text(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 512, fan_in: int = 8
) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay, one per distinct text."""
    kept = exact_groups(docs, id_col, text_col, keep, runs, fan_in).where("kept")
    named = F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.lit("null"))
    kept = settle(kept.select(named.alias("_dedup_id"), F.col("digest").alias("_dedup_digest")), "digest-kept")
    packed, back = sheltered(docs, id_col, text_col)
    rows = packed.withColumns(
        {
            "_dedup_id": F.coalesce(F.concat(F.lit("i"), packed[id_col].cast("string")), F.lit("null")),
            "_dedup_digest": F.unhex(F.sha2(text_of(packed, text_col), 256)),
        }
    ).join(kept, ["_dedup_id", "_dedup_digest"])
    again = Window.partitionBy("_dedup_id", "_dedup_digest").orderBy("_dedup_id")
    return back(rows.withColumn("_dedup_n", F.row_number().over(again)).where("_dedup_n = 1"))
