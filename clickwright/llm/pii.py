"""Personal data and what reveals it: base patterns plus information-theoretic sanitisation.

Base: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, as code-point spans.  ``split`` gives the
text between the matches and ``regexp_extract_all`` the matches, so positions are sums of lengths.  The patterns are
the plain ones, written so that Java's matcher needs linear time and no recursion: a match can only start where the run of
its first character class starts (or where the last match ended), and repeats are possessive.

Method: a term is a word in a text that mentions a protected entity (an address, number ...), at any distance.  Copies of a text are no further
evidence, so everything is counted over distinct texts: over all of them, with their number N, df(c) of the entity, df(t) of the term and
df(t, c) of both in one text,

    disclosure(t, c) = PMI(t; c) / IC(c),  PMI = log2(N df(t, c) / (df(t) df(c))),  IC = log2(N / df(c)),

is the share of the entity's information that the term gives away (1: the term occurs with the entity only).  A pair counts as
evidence from ``min_support`` texts on.  Terms with disclosure from ``generalise_at`` on are generalised (initial letter), from
``remove_at`` on removed, at all their places in each text that mentions the entity, in all copies alike; the entities themselves are replaced by their kind.

Three exact steps keep the pairs few.  Entities and terms of fewer than ``min_support`` texts make no pair.  As df(t, c) <= df(c), disclosure g
needs df(t) <= N^(1 - g) df(c)^g, so frequent words meet frequent entities only.  And entities (terms) of the same texts have
the same counts, so they are paired as one class.  Texts are brought together by a map-side aggregate, so a text of a third of all rows is one
row per task; counts are partial aggregates over all texts; hot terms and entities meet as one row per task.

Defined results: a null text is empty and has no spans.  Repeated rows have the same result and count once.  Null ids and extra columns pass.  An empty
table gives an empty result.  Terms that overlap a base span are not reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickwright.llm.common import let, settle, text_of

KINDS = ("email", "ip", "card", "phone", "term")
#: linear-time forms of the contract's patterns
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without it has no match, which is cheaper to see
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{4,}+(?!\.?[\p{L}\p{N}@_%+-])"
BLOCK = 256


def prefix_sums(sizes: Column) -> Column:
    """Sums before each element of an int array, in two levels: cheap also for 100,000 elements."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def outer(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / BLOCK).cast("int")), lambda j: add(F.slice(a, j * BLOCK + 1, F.lit(BLOCK))))

        def inner(b: Column) -> Column:
            at = F.transform(b, lambda x, j: add(F.slice(b, F.lit(1), j)))
            own = lambda i: add(F.slice(a, i - i % BLOCK + 1, i % BLOCK))
            return let(at, lambda o: F.transform(a, lambda x, i: F.get(o, F.floor(i / BLOCK).cast("int")) + own(i)))

        return let(blocks, inner)

    return let(sizes, outer)


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of all matches: start, end, match."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def build(g: Column, m: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(g, i)))

        def spans(before: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(g, i))
                return F.struct(start.alias("s"), (start + F.length(x)).alias("e"), x.alias("v"))

            return F.transform(m, one)

        return let(prefix_sums(steps), spans)

    return let(gaps, lambda g: let(found, lambda m: build(g, m)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(v, r"\."), lambda p: p.rlike(BYTE)),
        "card": F.when(n.between(13, 19), luhn(_digits(v))).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e, c>> by kind, then start; c is the entity as a 64-bit hash, so no value is stored."""

    def of(kind: str) -> Column:
        def keep(x: Column) -> Column:
            value = F.lower(x["v"]) if kind == "email" else F.regexp_replace(x["v"], "[^0-9.]", "") if kind == "ip" else _digits(x["v"])
            entity = F.xxhash64(F.lit(kind), value)
            return F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), entity.alias("c"))

        spans = F.transform(F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["v"])), keep)
        none = F.array().cast("array<struct<k:int,s:int,e:int,c:bigint>>")
        return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none) if NEEDS[kind] else spans

    return F.concat(*[of(k) for k in KINDS[:4]])


def _words(text: Column) -> Column:
    """The distinct words that may be terms, lower-cased one by one as terms are."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def _classes(rows: DataFrame, name: str, count: str, least: int) -> DataFrame:
    """(name, count, class): those of ``rows`` (uid, name) in ``least`` documents and more; the same documents make the same class."""
    own = rows.groupBy(name).agg(F.count(F.lit(1)).alias(count), F.bit_xor(F.xxhash64("uid")).alias("_of"))
    return own.where(F.col(count) >= least).select(name, count, F.xxhash64("_of", count).alias("class"))


def _apart(x: Column, spans: Column) -> Column:
    """Whether x overlaps none of the spans, disjoint ones in order: a search by halves for the last that starts before the end of x."""

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = F.get(spans, mid)["s"] < x["e"]
        lo, hi = F.when(right, mid + 1).otherwise(a["lo"]), F.when(right, a["hi"]).otherwise(mid)
        return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))

    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(spans))))
    last = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda a: a["lo"] - 1)
    return let(last, lambda i: (i < 0) | (F.get(spans, i)["e"] <= x["s"]))


def find_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_support: int = 2,
    generalise_at: float = 0.8,
    remove_at: float = 0.95,
) -> DataFrame:
    """One row per document: id, text_hash, spans (base), terms: array<struct<s, e, remove>> sorted, without overlaps with base spans."""
    text = text_of(docs, text_col)
    texts = docs.select(F.xxhash64(text).alias("uid"), text.alias("text")).groupBy("uid").agg(F.first("text").alias("text"))
    base = texts.select("uid", "text", base_spans(F.col("text")).alias("spans"), _words(F.col("text")).alias("words"))
    base = base.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))  # later passes need no other texts
    base = settle(base, "pii-base")
    n_docs = float(max(base.count(), 1))
    at_most = lambda df_c: F.pow(F.lit(n_docs), F.lit(1 - generalise_at)) * F.pow(df_c, F.lit(generalise_at)) * (1 + 1e-9)

    mentions = base.where(F.size("spans") > 0).select("uid", F.explode(F.array_distinct(F.col("spans.c"))).alias("c"))
    entities = mentions.join(_classes(mentions, "c", "df_c", min_support), "c").select("uid", F.col("class").alias("c"), "df_c").distinct()
    entities = settle(entities, "pii-entities")
    top = F.lit(float(entities.agg(F.max("df_c")).first()[0] or 1))
    of_term = base.select(F.explode("words").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df_t"))
    of_term = settle(of_term.where((F.col("df_t") >= min_support) & (F.col("df_t") <= at_most(top))), "pii-words")

    shown = base.join(entities.select("uid").distinct(), "uid", "left_semi")
    places = shown.select("uid", F.explode(located(F.col("text"), TERM)).alias("x")).select("uid", F.lower("x.v").alias("t"), "x.s", "x.e")
    places = settle(places.join(of_term, "t"), "pii-places")
    terms = places.select("uid", "t", "df_t").distinct()
    terms = terms.join(_classes(terms, "t", "_n", min_support), "t").select("uid", "t", F.xxhash64("class", "df_t").alias("w"), "df_t")
    terms = settle(terms, "pii-terms")

    met = entities.join(terms.select("uid", "w", "df_t").distinct(), "uid").where(F.col("df_t") <= at_most(F.col("df_c")))
    known = met.groupBy("c", "w", "df_c", "df_t").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= min_support)
    pmi = F.log2(F.col("both") * F.lit(n_docs) / (F.col("df_t") * F.col("df_c")))
    disclosure = F.coalesce(F.try_divide(pmi, F.log2(F.lit(n_docs) / F.col("df_c"))), F.lit(0.0))
    telling = settle(known.select("c", "w", disclosure.alias("disclosure")).where(F.col("disclosure") >= generalise_at), "pii-telling")

    worst = met.select("uid", "c", "w").join(telling, ["c", "w"]).groupBy("uid", "w").agg((F.max("disclosure") >= remove_at).alias("remove"))
    hits = places.select("uid", "t", "s", "e").join(terms.select("uid", "t", "w").join(worst, ["uid", "w"]), ["uid", "t"])
    hits = hits.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "e", "remove"))).alias("terms"))
    mails = F.filter("spans", lambda b: b["k"] == KINDS.index("email"))  # no other kind has letters
    none = F.array().cast("array<struct<s:int,e:int,remove:boolean>>")
    found = F.when(F.col("terms").isNull(), none).otherwise(let(mails, lambda m: F.filter("terms", lambda x: _apart(x, m))))
    marked = base.select("uid", "spans").join(hits, "uid", "left").select(F.col("uid").alias("text_hash"), "spans", found.alias("terms"))
    marked = settle(marked, "pii-marked")  # its size is known to the join below, which splits the rows of hot texts
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash")).join(marked, "text_hash").select("id", "text_hash", "spans", "terms")


def digest_columns(found: DataFrame) -> list[Column]:
    """n_email ... n_phone, base_sha256, spans as strings, n_terms."""
    joined = lambda spans, name: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = joined(found["spans"], lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]))
    more = joined(found["terms"], lambda x: F.lit("term"))
    of_kind = lambda i: F.size(F.filter("spans", lambda x: x["k"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    both = F.concat_ws(",", F.when(F.size("spans") > 0, base), F.when(F.size("terms") > 0, more))
    return [*counts, F.sha2(base, 256).alias("base_sha256"), both.alias("spans"), F.size("terms").cast("long").alias("n_terms")]


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text sanitised.  Of overlapping spans the first (then the longest) counts.  Cost: text length x its spans."""
    mark = lambda k: F.concat(F.lit("["), F.get(F.array(*[F.lit(x.upper()) for x in KINDS]), k), F.lit("]"))
    edit = lambda s, e, by: F.struct(s.alias("s"), (-e).alias("e"), by.alias("by"))
    base = F.transform("spans", lambda x: edit(x["s"], x["e"], mark(x["k"])))
    terms = F.transform("terms", lambda x: edit(x["s"], x["e"], F.when(x["remove"], F.lit("")).otherwise(F.lit(None).cast("string"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["e"]
        by = F.coalesce(x["by"], F.concat(F.substring("_pii_text", x["s"] + 1, F.lit(1)), F.lit("*")))
        put = F.concat(acc["out"], F.array(F.substring("_pii_text", acc["at"] + 1, x["s"] - acc["at"]), by))
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(end.alias("at"), put.alias("out")))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("_pii_text", acc["at"] + 1, F.length("_pii_text")))
    named = lambda c: F.coalesce(F.concat(F.lit("i"), c.cast("string")), F.lit("null"))
    edits = found.where((F.size("spans") > 0) | (F.size("terms") > 0)).select(
        named(F.col("id")).alias("_pii_id"), F.col("text_hash").alias("_pii_hash"), F.sort_array(F.concat(base, terms)).alias("_pii_edits")
    )
    edits = edits.dropDuplicates(["_pii_id", "_pii_hash"])
    # the columns of docs travel in one struct, so none of them can clash with those made here
    rows = docs.select(F.struct(*docs.columns).alias("_pii_row"), named(docs[id_col]).alias("_pii_id"), text_of(docs, text_col).alias("_pii_text"), F.xxhash64(text_of(docs, text_col)).alias("_pii_hash"))
    rows = rows.join(edits, ["_pii_id", "_pii_hash"], "left")
    clean = F.when(F.col("_pii_edits").isNull(), F.col("_pii_text")).otherwise(F.aggregate("_pii_edits", start, step, done))
    return rows.select(*[clean.alias(c) if c == text_col else F.col("_pii_row").getField(c).alias(c) for c in docs.columns])
