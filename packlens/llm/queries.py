"""The registered queries of the numbered operators: each applies one operator to its whole table."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.catalog.registry import Registry

R = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@R.add("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.sharding import shard

    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    placed = shard(table(spark, sf_dir, "documents"), keep=[F.col("doc_id"), crc])
    return placed.select(
        "row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@R.add("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.line_dedup import line_classes

    return line_classes(table(spark, sf_dir, "documents")).drop("text_key")


@R.add("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.language_id import detect, held_out, train

    docs = table(spark, sf_dir, "documents")
    return detect(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@R.add("op4_pseudo_likelihood")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.pseudo_likelihood import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))


@R.add("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).drop("ids")


def _crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII expression, bit by bit: DuckDB has no function for it."""
    bits = "list_reduce(range(0, 8), lambda x, k: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(a, b))"
    chars = f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce({chars}, lambda a, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@R.add("op7_decontaminate", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS win
         FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS win
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM places JOIN wins USING (size, win)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.decontaminate import contamination

    marks = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marks.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@R.add("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality", "p_toxic"
    )


TOKEN_LIMIT = 2048


@R.add("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


#: host, path, action
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_RULE_VALUES = ", ".join(str(r) for r in URL_RULES)


@R.add("op10_url_filters", f"""
WITH rules(rule_host, rule_path, action) AS (VALUES {_RULE_VALUES}),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                 regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest),
fits AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
         FROM (SELECT DISTINCT host, path FROM parts), rules
         WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits USING (host, path)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.url_filters import judge

    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_VALUES} AS rules(host, path, action)")
    return judge(table(spark, sf_dir, "pages"), rules)


@R.add("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.order_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: LR tops without their stacks: 0 start, 1 after s, 2 after a first u, 4 after ua, 5 after a later u.
_STEPS = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 4), (4, 'u', 5), (5, 'a', 4)"


@R.add("op11_turn_repair", f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {_crc32_sql("k")} % 20 AS kind FROM raw),
bad AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE kind <> 0),
seq AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM bad),
said AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM seq),
turns AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS sym,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair,
         CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM said),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id),
step(a, sym, b) AS (VALUES {_STEPS}),
ins(a, b, script, cost) AS (
  SELECT DISTINCT a, a, '', 0 FROM (SELECT a FROM step UNION SELECT b FROM step) UNION ALL
  SELECT a, b, 'I' || sym, 5 FROM step WHERE sym <> 's' UNION ALL
  SELECT x.a, y.b, 'I' || x.sym || 'I' || y.sym, 10 FROM step x JOIN step y ON x.b = y.a WHERE x.sym <> 's' AND y.sym <> 's'),
act(a, b, script, cost, sym, drops) AS (
  SELECT a, b, script || 'D', cost + 2, NULL, true FROM ins UNION ALL
  SELECT i.a, s.b, i.script || 'K', i.cost, s.sym, false FROM ins i JOIN step s ON i.b = s.a UNION ALL
  SELECT i.a, s.b, i.script || 'R' || s.sym, i.cost + 1, NULL, false FROM ins i JOIN step s ON i.b = s.a WHERE s.sym <> 's'),
way(conv_id, i, a, cost, script) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '' FROM turns
  UNION ALL
  SELECT conv_id, i, b, min(cost), arg_min(script, {{'c': cost, 's': script}}) FROM (
    SELECT t.conv_id, t.i, m.b, (w.cost + m.cost + CASE WHEN t.fault = 'truncated' AND NOT m.drops THEN 5 ELSE 0 END)::BIGINT AS cost, w.script || m.script AS script
    FROM way w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN act m ON m.a = w.a
    WHERE (m.drops OR t.fault NOT IN ('blank', 'duplicate')) AND (m.sym IS NULL OR m.sym = t.sym)) GROUP BY conv_id, i, b),
best AS (
  SELECT w.conv_id, min(w.cost + e.cost) AS cost, arg_min(w.script || e.script, {{'c': w.cost + e.cost, 's': w.script || e.script}}) AS script
  FROM way w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ins e ON e.a = w.a AND e.b IN (0, 4) GROUP BY w.conv_id),
edits AS (SELECT conv_id, unnest(tokens) AS edit, unnest(range(1, len(tokens) + 1)) AS p
          FROM (SELECT conv_id, regexp_extract_all(script, '[IR][ua]|K|D') AS tokens FROM best)),
spots AS (SELECT *, sum(CASE WHEN edit[1] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM edits),
lines AS (
  SELECT s.conv_id, s.p, CASE WHEN edit = 'K' THEN role || ':' || text
         ELSE CASE edit[2] WHEN 'u' THEN 'user:' ELSE 'assistant:' END || CASE edit[1] WHEN 'R' THEN text ELSE '' END END AS line
  FROM spots s LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i WHERE edit <> 'D'),
said2 AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS sha FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(regexp_replace(script, '[a-z]', '', 'g'), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN said2 s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.sequences import EMPTY_SHA256, digests
    from packlens.llm.turn_repair import damage, repair

    conversations = table(spark, sf_dir, "conversations")
    fixed = repair(damage(conversations))
    lines = fixed.turns.where("size(lines) > 0").select("conv_id", "at", F.array_join("lines", "\n").alias("line"))
    said = digests(lines, "conv_id", "at", "line", "\n", "repaired_sha256").withColumnRenamed("conv_id", "s")
    counts = fixed.conversations.withColumnRenamed("conv_id", "c")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(counts, ids["conv_id"].eqNullSafe(counts["c"]), "left").join(said, ids["conv_id"].eqNullSafe(said["s"]), "left")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )


@R.add("op12_best_fit")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.best_fit import pack

    return pack(table(spark, sf_dir, "documents"))


@R.add("op13_prefix_trie", f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
  SELECT c.conv_id, 0 AS half, o.p, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.p < c.h UNION ALL
  SELECT c.conv_id, 1, o.p, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.p >= c.h),
said AS (SELECT c.conv_id, coalesce(x.turns, []) AS turns FROM convs c LEFT JOIN (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY half, p) AS turns FROM parts GROUP BY conv_id) x USING (conv_id)),
firsts AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM said),
placed AS (SELECT conv_id, depth, turns[1:depth] AS path, depth = len(turns) AS ends FROM firsts),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM placed GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(length(path[depth].text), 0) AS saved FROM nodes n LEFT JOIN kids USING (path, depth)),
up AS (SELECT *, unnest(range(0, depth + 1)) AS d FROM whole),
sums AS (SELECT path[1:d] AS path, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (path, depth) LEFT JOIN nodes p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.path = w.path[1:w.depth - 1]
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packlens.llm.prefix_trie import share_heads, trie, turn_items
    from packlens.session import settle

    conversations = table(spark, sf_dir, "conversations")
    turns = settle(turn_items(conversations), "items")
    return trie(share_heads(turns), turns.select("conv_id").distinct()).drop("key")


@R.add("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).drop("ids")
