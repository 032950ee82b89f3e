"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised and end with one end id; those longer than a sequence are cut into full pieces, the first one shorter.
Full pieces are sequences of their own.  All shorter pieces are packed:

* Pieces are dealt by hash into shards of about ``shard_items`` pieces: a subproblem of bounded size.
* Each shard is evolved on ``islands`` islands, each with its own population.  A gene is a bin.  Crossover injects
  whole well-filled bins of one parent into the other, removes the bins that hold a duplicate, and best-fits the displaced pieces;
  mutation empties the worst bins.  Fewer bins win, and of as many the higher fitness, the mean squared fill.
* Between epochs the best of an island moves to the next island (a shuffle of one row per island).
* Bins filled to ``1 - slack`` are final.  Pieces of all other bins go to a smaller set of shards,
  until one shard is left.  Where too few bins fill up, the fuller half of each shard's bins is final, too, so that the
  worst ones always meet in one shard.  So the loss does not grow with the number of shards.

A task holds one island: ``shard_items`` piece lengths and a few assignments, whatever the size of the input.

Defined results: a null or empty text is one end id.  Repeated rows and null ids are documents of their own.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwright.llm.common import settle, ship, text_of
from clickwright.llm.tokens import encoded

STATE = "shard int, island int, fitness double, lengths array<int>, bins array<int>"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the first one shorter if they don't divide evenly."""
    first = n - (n - 1) // size * size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per piece: uid, doc_id, piece, start, length, ids_crc32."""
    id_type = docs.schema[id_col].dataType.simpleString()
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encoded(tokenizer, b.column(1).to_pylist())):
                ids = np.append(ids, end_id).astype("<u4")
                rows += [(doc, i, s, n, zlib.crc32(ids[s : s + n])) for i, (s, n) in enumerate(cut(len(ids), size))]
            cols = list(zip(*rows)) or [()] * 5
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t")).mapInArrow(of, schema)
    return settle(rows.withColumn("uid", F.monotonically_increasing_id()), "pieces")


class Bins:
    """Bins by room left, with best fit by one bit search."""

    def __init__(self, size: int) -> None:
        self.size, self.items, self.room = size, [], []
        self.by_room: dict[int, list[int]] = {}
        self.open = 0

    def add(self, items: list[int], room: int) -> None:
        self.items.append(items)
        self.room.append(room)
        self._file(len(self.room) - 1, room)

    def _file(self, b: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(b)
            self.open |= 1 << room

    def best_fit(self, order: list[int], lengths: list[int]) -> None:
        for i in order:
            n = lengths[i]
            mask = self.open >> n
            if not mask:
                self.add([i], self.size - n)
                continue
            room = n + (mask & -mask).bit_length() - 1
            same = self.by_room[room]
            b = same.pop()
            if not same:
                self.open &= ~(1 << room)
            self.items[b].append(i)
            self.room[b] = room - n
            self._file(b, room - n)


def fitness(room: list[int], size: int) -> float:
    fill = 1 - np.array(room, float) / size
    return float((fill * fill).mean()) if len(fill) else 1.0


def crossover(a: Bins, b: Bins, lengths: list[int], rng: np.random.Generator, share: float = 0.5) -> Bins:
    """Bins of b, with well-filled bins of a injected whole; bins of b with a duplicate go and their pieces are best-fitted again."""
    limit = np.quantile(a.room, 0.5)
    chosen = [i for i, r in enumerate(a.room) if r <= limit and rng.random() < share]
    child, taken = Bins(a.size), set()
    for i in chosen:
        child.add(list(a.items[i]), a.room[i])
        taken.update(a.items[i])
    loose = []
    for items, room in zip(b.items, b.room):
        if taken.isdisjoint(items):
            child.add(list(items), room)
        else:
            loose += [x for x in items if x not in taken]
    child.best_fit(sorted(loose, key=lambda x: -lengths[x]), lengths)
    return child


def mutate(a: Bins, lengths: list[int], rng: np.random.Generator, share: float = 0.05) -> Bins:
    """Empty the worst bins and a few others, and best-fit their pieces in a shaken order."""
    worst = set(np.argsort(a.room)[-max(2, int(share * len(a.room))) :].tolist()) | set(rng.integers(len(a.room), size=3).tolist())
    child, loose = Bins(a.size), []
    for i, (items, room) in enumerate(zip(a.items, a.room)):
        if i in worst:
            loose += items
        else:
            child.add(list(items), room)
    child.best_fit(sorted(loose, key=lambda x: -lengths[x] * rng.uniform(0.8, 1.2)), lengths)
    return child


def evolve(lengths: list[int], size: int, rng: np.random.Generator, guests: list[list[int]], people: int, generations: int) -> Bins:
    """The best individual after some generations.  guests: assignments (bin of each piece) from here or from other islands."""
    n = len(lengths)

    def fresh(jitter: float) -> Bins:
        out = Bins(size)
        key = -np.array(lengths) * rng.uniform(1 - jitter, 1 + jitter, n)
        out.best_fit(np.argsort(key, kind="stable").tolist(), lengths)
        return out

    def seated(bins: list[int]) -> Bins:
        groups: dict[int, list[int]] = {}
        for i, g in enumerate(bins):
            groups.setdefault(g, []).append(i)
        out = Bins(size)
        for items in groups.values():
            out.add(items, size - sum(lengths[i] for i in items))
        return out

    least = -(-sum(lengths) // size)
    crowd = [seated(g) for g in guests] or [fresh(0.0)]
    score = lambda x: (-len(x.room), fitness(x.room, size))
    if min(len(x.room) for x in crowd) > least:
        crowd += [fresh(0.1 * (i + 1) / people) for i in range(people - len(crowd))]
        crowd.sort(key=score, reverse=True)
        for _ in range(generations):
            if len(crowd[0].room) <= least:
                break
            i, j = sorted(rng.choice(len(crowd), 2, replace=False).tolist())
            child = crossover(crowd[i], crowd[j], lengths, rng)
            for new in (child, mutate(child, lengths, rng)):
                if score(new) > score(crowd[-1]):
                    crowd[-1] = new
                    crowd.sort(key=score, reverse=True)
    return max(crowd, key=score)


def _islands(size: int, people: int, generations: int, seed: int):
    def of(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        shard, island = (int(x) for x in key)
        lengths = [int(x) for x in states["lengths"].iloc[0]]
        guests = [list(map(int, b)) for b in states["bins"] if b is not None]
        rng = np.random.default_rng([seed, shard, island, len(guests)])
        best = evolve(lengths, size, rng, guests, people, generations)
        bins = np.empty(len(lengths), np.int32)
        for b, items in enumerate(best.items):
            bins[items] = b
        return pd.DataFrame({"shard": [shard], "island": [island], "fitness": [fitness(best.room, size)], "lengths": [lengths], "bins": [bins.tolist()]})

    return of


def pack(
    items: DataFrame,
    size: int = 2048,
    shard_items: int = 4096,
    islands: int = 2,
    epochs: int = 2,
    people: int = 4,
    generations: int = 12,
    slack: float = 0.004,
    seed: int = 11,
) -> DataFrame:
    """(uid, sequence_id, offset) for ``items`` (uid, length), written tables both.  A sequence is named by its smallest uid:
    the uid itself for a full piece, -1 - uid for a packed one."""
    ship(items.sparkSession)
    full = items.where(F.col("length") >= size).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.where(F.col("length") < size).select("uid", F.col("length").cast("int").alias("length"))
    done, n, level = [full], left.count(), 0
    most = n
    while n:
        shards = min(most, -(-n // shard_items))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(seed + level)), F.lit(shards)).cast("int"))
        rows = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
        rows = settle(rows.select("shard", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths")), "shards")
        state = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0.0).alias("fitness"), "lengths", F.lit(None).cast("array<int>").alias("bins"))
        for _ in range(epochs):
            state = settle(state.groupBy("shard", "island").applyInPandas(_islands(size, people, generations, seed), STATE), "islands")
            moved = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
            state, last = state.unionByName(moved), state
        best = last.groupBy("shard").agg(F.max_by("bins", F.struct(-F.array_max("bins"), "fitness", "island")).alias("bins"))
        zipped = F.arrays_zip(F.col("uids").alias("uid"), F.col("lengths").alias("length"), F.col("bins").alias("bin"))
        seats = rows.join(best, "shard").select("shard", F.explode(zipped).alias("x")).select("shard", "x.uid", "x.length", "x.bin")
        bins = seats.groupBy("shard", "bin").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"), F.sum("length").alias("fill"))
        bins = settle(bins.withColumn("final", (F.col("fill") >= size * (1 - slack)) | F.lit(shards == 1)), "bins")
        remains = bins.where("not final").agg(F.sum(F.size("items"))).first()[0] or 0
        if remains >= 0.95 * n:  # most of what is left does not fill any better: only the worse half is pooled
            turn = Window.partitionBy("shard").orderBy("final", "fill", "bin")
            half = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("shard", "final")) / 2)
            bins = settle(bins.withColumn("final", F.col("final") | (F.row_number().over(turn) > half)), "bins")
        done.append(_placed(bins.where("final")))
        left = bins.where("not final").select(F.explode("items").alias("x")).select("x.uid", "x.length")
        was, n, level = n, left.count(), level + 1
        if n >= 0.95 * was:  # shards of hardly more than a bin
            most = max(1, shards // 2)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _placed(bins: DataFrame) -> DataFrame:
    """Rows of written bins: uid, sequence_id, offset."""
    upto = lambda i: F.aggregate(F.slice("items", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["length"])
    seats = F.transform("items", lambda x, i: F.struct(x["uid"].alias("uid"), upto(i).alias("offset")))
    name = -1 - F.col("items")[0]["uid"]
    return bins.select(name.alias("sequence_id"), F.explode(seats).alias("x")).select("x.uid", "sequence_id", "x.offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **how
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    table = pieces(docs, tokenizer, size, end_id, id_col, text_col)
    return table.join(pack(table.select("uid", "length"), size, **how), "uid").drop("uid")
