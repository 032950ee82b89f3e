"""Spelling variants: frequent words one edit apart, found by PartEnum signatures of their letter multisets.

* A word's letters, each with its number among equal ones, are the ones of a binary vector.  One inserted, deleted or replaced
  letter changes this vector in one or two places, so near words have vectors at Hamming distance one or two (never zero).
* The dimensions are dealt into ``first`` parts of ``second`` subparts by letter, frequent letters apart.  Of ``first`` parts one has at most
  ``k2 = (2 + 1 + first - 1) // first - 1`` differences, and for each choice of ``second - k2`` of its subparts the projection on these is a
  signature.  Vectors within distance two share one at least.  Words with the same letters share a vector, which is signed once.
* Vectors meet in an equi-join on the signature and are verified by their exact difference.  Groups of over ``direct`` vectors do not list their
  pairs: there a second key, the vector's projection on the subparts left out without one letter, is joined too, which is exact as well.
* A verified pair of vectors says which letter a word of one may lose.  Words that agree after such a loss, at the same place (replaced) or
  with the whole other word (inserted), are near; at most 90 letters fit a place, so a word has a bounded number of neighbours.
* A word's form is its most frequent near word, if that is ``ratio`` times as frequent; forms are followed to their end by pointer doubling.

Words are counted by a map-side aggregate over all runs, so a word of a third of all runs costs one row per task.  The driver sees at most 90 letter
counts and the largest count.

Defined results: a null or empty text has no words; repeated rows count again; a null id reads as an empty string in the
check sum; an empty table gives an empty result; extra columns are ignored.  A very long text is one array of runs in one task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickwright.llm.common import settle, text_of

ALPHABET = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DISTANCE = 2


def runs(docs: DataFrame, at_least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): the maximal runs of letters of at least that length, A-Z in lower case.  Shorter runs can't become longer."""
    found = F.regexp_extract_all(text_of(docs, text_col), F.lit(f"([{ALPHABET}]{{{at_least},}})"), 1)
    key = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    rows = docs.select(key.alias("id"), F.explode(found).alias("run"))
    return rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))


def misspelt(rows: DataFrame, one_in: int = 199) -> Column:
    """The run, without one letter where its check sum says so: data with known variants."""
    h = F.crc32(F.concat_ws(":", rows["id"], rows["run"]))
    at = (h % F.length(rows["run"])).cast("int")
    cut = F.concat(F.substring(rows["run"], F.lit(1), at), F.substring(rows["run"], at + 2, F.length(rows["run"])))
    return F.when(h % one_in == 0, cut).otherwise(rows["run"])


def word_counts(words: DataFrame, word: str = "word", at_least: int = 6, times: int = 5) -> DataFrame:
    """(word, n) of the words of at least that length and count, with their vector: the sorted letters."""
    counted = words.where(F.length(word) >= at_least).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)
    return settle(counted.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), "")), "spelling-words")


def letter_parts(vectors: DataFrame, n: int) -> list[str]:
    """The letters in n parts, each as a string; the most frequent ones dealt first, in turn."""
    counts = vectors.select(F.explode(F.split("letters", "")).alias("c")).groupBy("c").count().collect()  # the alphabet: 90 rows at most
    ranked = [r["c"] for r in sorted(counts, key=lambda r: (-r["count"], r["c"]))]
    return ["".join(ranked[i::n]) for i in range(n)]


def left_out(parts: list[str], first: int, second: int) -> list[str]:
    """For each signature the letters that its projection leaves out."""
    k2 = -(-(DISTANCE + 1) // first) - 1
    out = []
    for i in range(first):
        own = range(i * second, (i + 1) * second)
        others = "".join(p for j, p in enumerate(parts) if j not in own)
        out += [others + "".join(parts[j] for j in gone) for gone in combinations(own, k2)]
    return out


def signatures(vectors: DataFrame, first: int = 1, second: int = 8) -> DataFrame:
    """(sig, letters, rest): the hashed projections of each vector, and the letters that each leaves out."""
    gone = left_out(letter_parts(vectors, first * second), first, second)
    if not any(gone):  # an empty table, or one letter only
        gone = gone[:1]
    one = lambda i, g: F.struct(F.lit(i).alias("i"), F.translate("letters", g or " ", "").alias("p"))
    rows = vectors.select("letters", F.explode(F.array(*[one(i, g) for i, g in enumerate(gone)])).alias("s"))
    return rows.select(F.xxhash64("s.i", "s.p").alias("sig"), "letters", F.col("s.p").alias("kept"))


def _numbered(letters: Column) -> Column:
    """The ones of a vector: each letter with its number among equal ones (the letters are sorted)."""
    chars = F.split(letters, "")
    return F.transform(chars, lambda c, i: F.concat(c, (i + 1 - F.array_position(chars, c)).cast("string")))


def _thinned(letters: Column) -> Column:
    """The sorted letters whole, and without one of each letter."""
    spots = F.sequence(F.lit(0), F.length(letters))
    return F.array_distinct(F.transform(spots, lambda i: F.when(i == 0, letters).otherwise(
        F.concat(F.substring(letters, F.lit(1), i - 1), F.substring(letters, i + 1, F.length(letters))))))


def near_vectors(vectors: DataFrame, first: int = 1, second: int = 8, direct: int = 256) -> DataFrame:
    """(a, b, lost, gained): distinct vectors a and b, in either order, where b is a without ``lost`` and with ``gained`` (one letter or none)."""
    sigs = settle(signatures(vectors, first, second), "spelling-signatures")
    sizes = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = sigs.join(sizes, "sig")
    small = sized.where(F.col("size") <= direct).select("sig", "letters")
    pairs = small.join(small.select("sig", F.col("letters").alias("b")), "sig").where("letters < b").select(F.col("letters").alias("a"), "b")
    large = sized.where(F.col("size") > direct).select("sig", "letters", F.explode(_thinned(F.col("letters"))).alias("key"))
    large = large.join(large.select("sig", "key", F.col("letters").alias("b")), ["sig", "key"]).where("letters < b").select(F.col("letters").alias("a"), "b")
    ones = lambda x, y: F.array_except(_numbered(F.col(x)), _numbered(F.col(y)))
    close = F.abs(F.length("a") - F.length("b")) <= 1
    met = pairs.where(close).unionByName(large.where(close)).withColumn("lost", ones("a", "b")).where("size(lost) <= 1")
    met = met.withColumn("gained", ones("b", "a")).where("size(gained) <= 1").distinct()
    of = lambda c: F.coalesce(F.substring(F.get(c, F.lit(0)), 1, 1), F.lit(""))
    one_way = met.select("a", "b", of("lost").alias("lost"), of("gained").alias("gained"))
    return one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("gained").alias("lost"), F.col("lost").alias("gained")))


def near_words(words: DataFrame, **how) -> DataFrame:
    """(word, near): words one inserted, deleted or replaced letter apart, in both orders, once each."""
    vectors = words.select("letters").distinct()
    links = near_vectors(vectors, **how)
    # what the words of a vector may lose, and whether the loss is made up for by another letter
    loss = settle(links.select(F.col("a").alias("letters"), "lost", (F.col("gained") != "").alias("swapped")).distinct(), "spelling-losses")
    chars = F.split("word", "")
    cut = lambda i: F.concat(F.substring("word", F.lit(1), i), F.substring(F.col("word"), i + 2, F.length("word")))
    spots = F.filter(F.transform(chars, lambda c, i: F.when(c == F.col("lost"), i)), lambda i: i.isNotNull())
    rests = F.transform(spots, lambda i: F.struct(cut(i).alias("rest"), F.when(F.col("swapped"), i).otherwise(F.lit(-1)).alias("at")))
    whole = F.array(F.struct(F.col("word").alias("rest"), F.lit(-1).alias("at")))
    key = F.when(F.col("lost") == "", whole).otherwise(F.array_distinct(rests))
    keyed = words.join(loss, "letters").select("word", (F.col("lost") == "").alias("whole"), F.explode(key).alias("k"))
    keyed = settle(keyed.select("k.rest", "k.at", "whole", "word"), "spelling-keys")
    other = keyed.select("rest", "at", F.col("whole").alias("whole_"), F.col("word").alias("near"))
    swapped = keyed.where("at >= 0").join(other.where("at >= 0"), ["rest", "at"]).where("word != near").select("word", "near")
    shorter, longer = keyed.where("at < 0 AND whole").select("rest", "word"), other.where("at < 0 AND NOT whole_").select("rest", "near")
    added = shorter.join(longer, "rest").select("word", "near")
    return swapped.unionByName(added).unionByName(added.select(F.col("near").alias("word"), F.col("word").alias("near")))


def spelling_forms(words: DataFrame, ratio: int = 5, **how) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n, letters; a written table)."""
    near = near_words(words, **how).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near").alias("form"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.col1")).alias("form_n"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n")
    fits = F.col("form_n") >= ratio * F.col("n")
    found = found.withColumns({"form": F.when(fits, F.col("form")), "form_n": F.when(fits, F.col("form_n"))})
    found = settle(found, "spelling-forms")
    top, hops = words.agg(F.max("n")).first()[0] or 1, 1
    while ratio**hops <= top:  # a form is at least `ratio` times as frequent, so no chain is longer
        hops += 1
    step = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < hops:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        reach *= 2
    out = found.join(step, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
