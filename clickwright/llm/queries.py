"""The registered queries of the operators, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwright.llm import arrow_tokens, conversations, exact_dedup, level_packing, licenses, mixing, packing, pii, quality_rules, simhash_dedup, spelling
from clickwright.llm import suffix_dedup, warc_audit
from clickwright.llm.common import documents, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op5_arrow_tokens")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = arrow_tokens.write_token_files(documents(spark, sf_dir), tokenizer_path())
    return arrow_tokens.read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "sequence")


@register("op6_simhash_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_components(documents(spark, sf_dir), shingle=4, max_bits=4, seed=42)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path(), 2048)


@register("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.with_features(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    rows = settle(rows.drop("text"), "quality-rows")
    out = quality_rules.judge(rows, quality_rules.fit_cutoffs(rows, documents(spark, sf_dir, "labels")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@register(
    "op9_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
              doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256,
              CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes
       FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", sha, "n_bytes")


@register("op10_temperature_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.measured(documents(spark, sf_dir), tokenizer=tokenizer_path()).select("doc_id", "_mix_source", "_mix_tokens", "_mix_hash")
    rows = settle(rows, "mix-rows")
    mix = mixing.plan_mix(rows, target_entropy=0.97, max_repeats=4.0)
    out = mixing.in_order(mixing.emit(rows, mix), mix)
    names = {"source": "source", "tokens": "n_tokens", "pass": "pass", "block": "block", "weight": "weight", "turn": "turn", "hash": "key"}
    return out.select("doc_id", *[F.col(f"_mix_{a}").alias(b) for a, b in names.items()])


@register("op3_disclosure_control")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), *pii.digest_columns(found))


@register("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


@register("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir), length=100)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register(
    "op2_merkle_fixity",
    """WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
                   || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html'
                   || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10)
                   || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages),
            o AS (SELECT page_id, rec, row_number() OVER (ORDER BY page_id) - 1 AS ord FROM r),
            f AS (SELECT page_id, rec, ord, ord // 4096 AS file, octet_length(encode(rec)) AS n FROM o),
            p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f),
            two AS (SELECT CASE page_id % 89 WHEN 4 THEN page_id + 1 WHEN 5 THEN page_id - 1 ELSE page_id END AS id,
                      CASE WHEN page_id % 97 = 13 THEN 'w' || substr(rec, 2) ELSE rec END AS rec FROM r WHERE page_id % 101 <> 7
                    UNION ALL SELECT -1 - page_id, rec FROM r WHERE page_id % 103 = 5),
            e AS (SELECT id, rec, octet_length(encode(rec)) AS n,
                    (SELECT 4096 * ((count(*) + 4095) // 4096) FROM r) + row_number() OVER (ORDER BY id) - 1 AS ord FROM two WHERE id NOT IN (SELECT page_id FROM r)),
            x AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY ord // 4096 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
       SELECT page_id, CAST(ord AS BIGINT) AS ord, CAST(file AS BIGINT) AS file, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS length,
              sha256(p.rec) AS record_sha256, CASE WHEN two.id IS NULL THEN 'lost' WHEN two.rec <> p.rec THEN 'damaged' ELSE 'same' END AS status
       FROM p LEFT JOIN two ON two.id = p.page_id
       UNION ALL SELECT id, CAST(ord AS BIGINT), CAST(ord // 4096 AS BIGINT), CAST(start AS BIGINT), CAST(n AS BIGINT), sha256(rec), 'extra' FROM x""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages with their places, and what the audit finds of them in a second replica.

    The second replica flips a byte in the record of every 97th page, lacks every 101st, has two of every 89 under each other's
    id and a copy of every 103rd under a new one.
    """
    pages = documents(spark, sf_dir, "pages")
    page = F.col("page_id")
    good = pages.select(page, warc_audit.warc_record(F.col("url"), F.col("html"), page).alias("record"))
    flipped = F.concat(F.lit(b"w"), F.substring("record", F.lit(2), F.octet_length("record")))
    swapped = F.when(page % 89 == 4, page + 1).when(page % 89 == 5, page - 1).otherwise(page)
    other = good.where(page % 101 != 7).select(swapped.alias("page_id"), F.when(page % 97 == 13, flipped).otherwise(F.col("record")).alias("record"))
    other = other.unionByName(good.where(page % 103 == 5).select((-1 - page).alias("page_id"), "record"))
    one = warc_audit.leaves(good)
    two = warc_audit.placed(other, one)
    found = warc_audit.audit(warc_audit.merkle_tree(one), warc_audit.merkle_tree(two))
    found = found.select("ord", F.when(F.col("hash_two").isNull(), "lost").when(F.col("hash_one").isNull(), "extra").otherwise("damaged").alias("status"))
    known = one.join(found, "ord", "left").withColumn("status", F.coalesce("status", F.lit("same")))
    out = known.unionByName(two.join(found.where("status = 'extra'"), "ord"))
    return out.select(F.col("id").alias("page_id"), "ord", "file", "start", "length", F.col("hash").alias("record_sha256"), "status")


def crc32_sql(text: str) -> str:
    """DuckDB: the unsigned crc32 of an ASCII or Latin-1 string's UTF-8 bytes, by the bits of its polynomial."""
    code = "unicode(c)"
    bytes_ = (
        f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN {code} < 128 THEN [CAST({code} AS BIGINT)] "
        f"ELSE [CAST(192 + ({code} >> 6) AS BIGINT), CAST(128 + ({code} & 63) AS BIGINT)] END))"
    )
    bits = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(h, b))"
    return f"xor(list_reduce({bytes_}, lambda h, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


@register(
    "op11_spelling_variants",
    f"""WITH RECURSIVE t AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM
              (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
            h AS (SELECT r, c, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM
              (SELECT doc_id, r, count(*) AS c FROM t WHERE length(r) >= 6 GROUP BY ALL)),
            e AS (SELECT c, CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w FROM h),
            w AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM e WHERE length(w) >= 6 GROUP BY w HAVING sum(c) >= 5),
            cut AS (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS v FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM w)),
            near AS (SELECT a.w, b.w AS f, b.n FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.w <> b.w
              UNION SELECT a.w, b.w, b.n FROM cut a JOIN w b ON a.v = b.w
              UNION SELECT b.w, a.w, a.n FROM cut a JOIN w b ON a.v = b.w),
            top AS (SELECT w, count(*) AS n_near, first(f ORDER BY n DESC, f) AS f, max(n) AS f_n FROM near GROUP BY w),
            form AS (SELECT w.w, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN f_n >= 5 * w.n THEN f END AS form, CASE WHEN f_n >= 5 * w.n THEN f_n END AS form_n
              FROM w LEFT JOIN top ON w.w = top.w),
            walk AS (SELECT w, w AS x, 0 AS k FROM form UNION ALL SELECT walk.w, form.form, k + 1 FROM walk JOIN form ON walk.x = form.w WHERE form.form IS NOT NULL)
       SELECT form.w AS word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n
       FROM form JOIN (SELECT w, arg_max(x, k) AS root FROM walk GROUP BY w) r ON form.w = r.w""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(documents(spark, sf_dir), at_least=6)
    words = spelling.word_counts(found.select(spelling.misspelt(found, one_in=199).alias("word")), at_least=6, times=5)
    return spelling.spelling_forms(words, ratio=5)


def repair_sql() -> str:
    """Least (cost, audit) over the states of ``(s?(ua)+)?``: e before anything, s, u after a user, p after a pair; as text, the cost in 12 digits first."""
    moves = {"s": [("e", "s")], "u": [("e", "u"), ("s", "u"), ("p", "u")], "a": [("u", "p")]}
    reach = {"e": [("e", 0), ("u", 1), ("p", 2)], "s": [("s", 0), ("u", 1), ("p", 2)], "u": [("u", 0), ("p", 1)], "p": [("p", 0), ("u", 1)]}

    def way(state: str, cost: str, audit: str) -> str:
        return f"lpad(CAST(CAST(left({state}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}, 13) || '{audit}'"

    ways: dict[str, list[str]] = {x: [] for x in reach}
    for start, ends in reach.items():
        for mid, k in ends:
            ways[mid].append(way(f"dp.{start}", f"{2 * k + 3}", "I" * k + "D"))
            for c, steps in moves.items():
                for a, b in steps:
                    if a == mid:
                        ways[b].append(f"CASE WHEN may AND c = '{c}' THEN {way(f'dp.{start}', f'{2 * k} + cut', 'I' * k + 'K')} END")
                        if c != "s":
                            ways[b].append(f"CASE WHEN may AND c <> '{c}' THEN {way(f'dp.{start}', f'{2 * k + 2} + cut', 'I' * k + 'R')} END")
    step = ", ".join(f"least({', '.join(w)}) AS {x}" for x, w in ways.items())
    ends = [way(start, f"{2 * k}", "I" * k) for start, es in reach.items() for mid, k in es if mid in "ep"]
    key = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} % 20 AS kind FROM conversations),
      d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
              CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
              unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE kind <> 0),
      o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {white}) AS bare FROM d),
      f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, left(role || ' ', 1) AS c FROM o),
      g AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS may, CAST(fault = 'truncated' AS INT) AS cut, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
      n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
              count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
              count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
      dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS p FROM n
             UNION ALL SELECT g.conv_id, g.i, {step} FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.i = dp.i + 1),
      best AS (SELECT dp.conv_id, least({', '.join(ends)}) AS b FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i),
      acts AS (SELECT conv_id, a, k, count(*) FILTER (a <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM
              (SELECT conv_id, unnest(string_split(substr(b, 13), '')) AS a, unnest(range(1, length(b) - 11)) AS k FROM best WHERE length(b) > 12)),
      kept AS (SELECT acts.conv_id, a, k, CASE WHEN a = 'I' THEN '' ELSE text END AS text, role, a = 'K' AND c = 's' AS system FROM acts
              LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM acts.conv_id AND g.i = acts.i AND a <> 'I' WHERE a <> 'D'),
      told AS (SELECT conv_id, k, CASE WHEN a = 'K' THEN role WHEN count(*) FILTER (NOT system) OVER (PARTITION BY conv_id ORDER BY k) % 2 = 1 THEN 'user' ELSE 'assistant' END
              || ':' || text AS line FROM kept),
      lines AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM told GROUP BY conv_id)
      SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
             coalesce(illegal, 0) AS illegal, coalesce(CAST(left(b, 12) AS BIGINT), 0) AS cost, coalesce(substr(b, 13), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
           LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM a.conv_id"""


@register("op12_conversation_repair", repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.conversation_rows(documents(spark, sf_dir, "conversations"))
    return conversations.repair_all(conversations.damaged(rows), rows)


@register("op13_sum_of_squares_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return level_packing.place_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048, end_id=1)
