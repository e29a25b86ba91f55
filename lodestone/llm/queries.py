"""The registered queries of the training-data operators, over the whole tables of a data folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lm_scoring, main_text, near_dedup, packing, periodic_runs, pii, quality_rules, secret_scan, sharding, token_counts, token_files
from ._common import SPACE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), F.expr("crc32(CAST(CAST(doc_id AS string) AS binary)) % 7 = 2"), order=3)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    spans = "array_join(array_distinct(transform({}, f -> concat_ws(':', f.kind, f.start, f.end))), ',')"
    clear = "filter(findings, f -> f.via = '')"
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter({clear}, f -> f.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.expr(f"sha2({spans.format(clear)}, 256)").alias("base_sha256"),
        F.expr(spans.format("findings")).alias("spans"),
        F.expr("CAST(size(filter(findings, f -> f.via <> '')) AS bigint)").alias("n_decoded"),
        "n_layers",
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")) + 8
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    sharded = sharding.hilbert_shards(docs, {"source": F.col("source"), "lang": F.col("lang"), "size": size}, shards=24, carry={"size": size, "text_crc32": crc})
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Spec(width=3, percent=85))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.failed("base-1").alias("base_failed"), (~quality_rules.failed("web-1")).alias("kept"), "n_lines", "n_upper", "fail_bits",
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy web-1 costs, from the bits of op7's ledger."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), "web-1")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(images)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    kinds = [F.expr(f"CAST(size(filter(hits, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in pii.PATTERNS]
    return replaced.select("doc_id", "text", "n_replaced", *kinds)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's documents, of which some ten in a hundred repeat a part of themselves, through the operator."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("crc32(CAST(CAST(doc_id AS string) AS binary))").alias("h"))
    # Only those texts are parted into words here, as no other has h, g, n, a or p to compute.
    words = docs.withColumn("w", F.when(F.expr("h % 10 = 0"), F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")))
    sized = words.withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("IF(n > 0, h div 10 % n, 0L)")).withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    repeated = "array_join(transform(sequence(0L, n - 1), i -> w[CAST(IF(i < a, i, a + (i - a) % p) AS int)]), ' ')"
    found = periodic_runs.periodic_runs(sized.select("doc_id", F.expr(f"IF(w IS NOT NULL AND n > 0, {repeated}, text)").alias("text")))
    best = found.withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS least)))"))
    return best.select(
        "doc_id", F.expr("CAST(size(runs) AS bigint)").alias("n_runs"), F.expr("-best.back").alias("start"), F.expr("best.length").alias("length"), F.expr("-best.least").alias("period"),
        F.expr("1000 * best.length div -best.least").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), chr(10))), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: A deployment passes its own secret; this one makes the queries repeatable.
PII_KEY = "lodestone-demo-key"

OP7_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), parsed AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), placed AS (
  SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM parsed
), windows AS (
  SELECT rid, pos, word, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3 FROM placed WINDOW w AS (PARTITION BY rid ORDER BY pos)
), counted AS (
  SELECT rid, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, w2, w3) > 1 AS again FROM windows
), covered AS (
  SELECT rid, again OR coalesce(lag(again, 1) OVER w, false) OR coalesce(lag(again, 2) OVER w, false) AS inside FROM counted WINDOW w AS (PARTITION BY rid ORDER BY pos)
), repeated AS (
  SELECT rid, count(*) FILTER (WHERE inside) AS n FROM covered GROUP BY rid
), measured AS (
  SELECT p.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS BIGINT) AS n_upper
  FROM parsed p LEFT JOIN repeated r USING (rid)
), bits AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_upper > 50 * word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper, fail_bits FROM bits
"""

ABLATIONS_SQL = (
    OP7_SQL.rpartition("SELECT")[0]
    + """SELECT rule, CAST(count(*) FILTER (WHERE fail_bits & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (WHERE fail_bits = bit) AS BIGINT) AS n_alone, CAST(count(*) FILTER (WHERE fail_bits & ~bit = 0) AS BIGINT) AS n_kept_without
FROM bits, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('shouting', 16), ('word_length', 32)) AS rules(rule, bit) GROUP BY rule"""
)

OP5_SQL = r"""
WITH RECURSIVE parsed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM parsed
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS origin, doc_id AS place FROM sets UNION SELECT r.origin, l.b FROM reached r JOIN links l ON l.a = r.place
), components AS (
  SELECT origin AS doc_id, min(place) AS component_id FROM reached GROUP BY origin
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN components USING (doc_id)
"""

OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) AS h
  FROM documents
), sized AS (
  SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM texts
), planted AS (
  SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM sized
), placed AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM planted
), apart AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.rid = y.rid AND x.word = y.word AND x.i < y.i
), islands AS (
  SELECT rid, q, min(i) AS s, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM apart) GROUP BY rid, q, island HAVING count(*) >= q AND count(*) + q >= 12
), runs AS (
  SELECT rid, s, m + q AS length, min(q) AS q FROM (SELECT rid, s, m, q FROM islands) GROUP BY rid, s, m + q
), told AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM runs GROUP BY rid
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, s, q) = 1
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM placed p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.rid = p.rid AND p.i >= r.s + r.q AND p.i < r.s + r.length) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * length // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM planted LEFT JOIN told USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""

QUERIES = {
    "op1_elias_fano_lm": op1,
    "op2_secret_worklist": op2,
    "op3_hilbert_shards": op3,
    "op4_pigeonhole_decontamination": op4,
    "op5_bbit_minhash": op5,
    "op6_heap_pair_merge_counts": op6,
    "op7_rule_bitmask_ledger": op7,
    "rule_ablations": rule_ablations,
    "op8_power_of_two_packing": op8,
    "op9_simple8b_files": op9,
    "op10_feistel_pseudonyms": op10,
    "op11_recurrent_labeller": op11,
    "op12_harmonic_runs": op12,
}
ORACLES = {"op5_bbit_minhash": OP5_SQL, "op7_rule_bitmask_ledger": OP7_SQL, "rule_ablations": ABLATIONS_SQL, "op12_harmonic_runs": OP12_SQL}
