"""WARC records and a Merkle fixity audit of replicas.

Records (leaves) have an ordered place in a file: ordinal, offset, length, and a SHA-256 of their bytes.  A node of level n covers
``fan`` nodes of level n - 1; its hash is the SHA-256 of their offset ranges and hashes, in order.  Files hold a power of ``fan`` records, so each
file has its root on one level, and the levels above lead to one root of the archive.  Replicas with equal roots are equal.  Otherwise only the children of
mismatching nodes are compared, level by level, down to the records; ranges that one replica lacks show as missing.

The places of one replica are the manifest of the others: ``placed`` puts a replica's records where the manifest has the same record (the k-th of
equal ones where that has its k-th), and those left over at the free places of their id, in order.  A lost record leaves a gap and moves nothing
behind it.  Records that the manifest lacks follow in files of their own.

No group holds more than ``fan`` nodes or one file's records.  Each level is written by itself, so a descent reads the branches that
it needs and nothing else of the tree.

Defined results: null urls and bodies are empty.  Null and repeated ids are records of their own, in the order of (id, digest).  Empty replicas
have no root and are equal; an empty one against another has every record missing.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwright.llm.common import settle
from clickwright.plans.ordered import global_rank

CRLF = "\r\n"
_KEY = ["id", "hash", "length"]


def warc_record(url: Column, body: Column, name: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """The bytes of a WARC/1.1 resource record."""
    url, body, name = (F.coalesce(c.cast("string"), F.lit("")) for c in (url, body, name))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), name,
        F.lit(f">{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"),
        F.lit(CRLF * 2),
    )
    return F.concat(head, body, F.lit(CRLF * 2)).cast("binary")


def _numbered(rows: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in ``order``, which starts with ``within``, and under ``name`` the number among rows equal in ``within``, from 0."""
    rows = settle(global_rank(rows, order, "rank"), "warc-ranks")
    first = rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in within]).agg(F.min("rank").alias("first"))
    same = F.lit(True)
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return rows.join(first, same).withColumn(name, F.col("rank") - F.col("first")).drop("first", *first.columns)


def _records(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """id, length, hash, rank, and copy: the number among equal records."""
    rows = records.select(
        records[id_col].alias("id"), F.octet_length(record_col).cast("long").alias("length"), F.sha2(record_col, 256).alias("hash")
    )
    return _numbered(settle(rows, "warc-records"), _KEY, _KEY, "copy")


def _in_files(rows: DataFrame, per_file: int) -> DataFrame:
    """Files and offsets of rows that have their ``ord``."""
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    rows = rows.withColumn("file", F.floor(F.col("ord") / per_file).cast("long"))
    return rows.select("ord", "file", start.alias("start"), "length", "hash", "id", "copy")


def leaves(records: DataFrame, per_file: int = 4096, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """A written table: ord (in the archive), file, start, length, hash, id, copy.  Files hold ``per_file`` records in id order."""
    rows = _records(records, id_col, record_col).withColumn("ord", F.col("rank") - 1)
    return settle(_in_files(rows, per_file), "warc-leaves")


def placed(
    records: DataFrame, manifest: DataFrame, per_file: int = 4096, id_col: str = "page_id", record_col: str = "record"
) -> DataFrame:
    """The leaves of another replica: its records at the places that ``manifest`` (the leaves of the first) gives them."""
    rows = _records(records, id_col, record_col).drop("rank")
    place = manifest.select("ord", "file", "start", F.struct(*_KEY, "copy").alias("of"))
    same = F.col("id").eqNullSafe(F.col("of.id"))
    for c in ("hash", "length", "copy"):
        same = same & (F.col(c) == F.col(f"of.{c}"))
    rows = settle(rows.join(place, same, "left").drop("of"), "warc-placed")
    known = rows.where("ord is not null")
    free = manifest.join(known, "ord", "left_anti").select("id", "ord", "file", "start")
    free = _numbered(free, ["id"], ["id", "ord"], "nth").select(F.col("id").alias("of"), F.col("nth").alias("at"), "ord", "file", "start")
    rest = _numbered(rows.where("ord is null").drop("ord", "file", "start"), ["id"], [*_KEY, "copy"], "nth").drop("rank")
    rest = settle(rest.join(free, F.col("id").eqNullSafe(F.col("of")) & (F.col("nth") == F.col("at")), "left"), "warc-rest")
    columns = ["ord", "file", "start", "length", "hash", "id", "copy"]
    known = known.select(columns).unionByName(rest.where("ord is not null").select(columns))
    files = -(-manifest.count() // per_file)
    extra = rest.where("ord is null").select(*_KEY, "copy")
    extra = global_rank(extra, [*_KEY, "copy"], "rank").withColumn("ord", F.col("rank") - 1 + files * per_file)
    return settle(known.unionByName(_in_files(extra, per_file)), "warc-leaves")


def node_hash(children: Column) -> Column:
    """Of an array of structs (ord, file, start, length, hash), sorted."""
    line = lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("file", "start", "length")], x["hash"])
    return F.sha2(F.array_join(F.transform(children, line), "\n"), 256)


def merkle_tree(leaf: DataFrame, fan: int = 16) -> list[DataFrame]:
    """Levels (ord, file, start, length, hash), written, leaves first; the last one has the archive's root.

    With files of fan ** k records, level k has the files' roots.
    """
    level = leaf.select("ord", "file", "start", "length", "hash")
    levels, n = [level], level.count()
    while n > 1:
        up = level.groupBy(F.floor(F.col("ord") / fan).cast("long").alias("up"))
        up = up.agg(F.sort_array(F.collect_list(F.struct("ord", "file", "start", "length", "hash"))).alias("x"))
        total = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["length"])
        first = [F.col("x")[0][c].alias(c) for c in ("file", "start")]
        level = settle(up.select(F.col("up").alias("ord"), *first, total.alias("length"), node_hash(F.col("x")).alias("hash")), "merkle")
        levels.append(level)
        n = level.count()
    return levels


def root(levels: list[DataFrame]) -> str | None:
    """The archive's root hash, or None."""
    top = levels[-1].first()
    return top and top["hash"]


def audit(one: list[DataFrame], two: list[DataFrame], fan: int = 16) -> DataFrame:
    """Records that differ: ord, and file, start, length, hash of both (null where missing), with suffixes _one and _two.

    The highest level that both trees have is compared whole, lower ones only below nodes that differ.
    """
    values = ("file", "start", "length", "hash")
    side = lambda df, s: df.select("ord", *[F.col(c).alias(f"{c}_{s}") for c in values])
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"{c}_one").eqNullSafe(F.col(f"{c}_two"))
    suspects: DataFrame | None = None
    for i in reversed(range(min(len(one), len(two)))):
        a, b = side(one[i], "one"), side(two[i], "two")
        if suspects is not None:
            above = lambda x: x.withColumn("up", F.floor(F.col("ord") / fan).cast("long")).join(suspects, "up", "left_semi").drop("up")  # noqa: B023, E731
            a, b = above(a), above(b)
        found = settle(a.join(b, "ord", "full").where(~same), "merkle-differences")
        suspects = found.select(F.col("ord").alias("up"))
        if found.isEmpty():
            break
    return found.where(F.lit(i == 0))
