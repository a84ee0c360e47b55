"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.llm.common import new_path, table
from lakeline.llm.decontaminate import contaminated
from lakeline.llm.exact_dedup import exact_dedup
from lakeline.llm.fill_in_middle import fill_in_middle, restored
from lakeline.llm.hard_negatives import mine_hard_negatives
from lakeline.llm.language_id import language_of
from lakeline.llm.line_dedup import dedup_lines
from lakeline.llm.mixing import mix
from lakeline.llm.sharding import shard_rows
from lakeline.llm.simhash import simhash_groups
from lakeline.llm.substring_dedup import repeated_passages
from lakeline.llm.token_files import read_token_files, write_token_files
from lakeline.llm.url_filter import judge_urls
from lakeline.llm.warc import read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed values of the url contract: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op2_warc", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), near="edit").select("doc.doc_id", "text", "n_lines", "n_kept")


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_token_files(spark, path, with_ids=False)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))


# Target mix: crawl (the one large source) against all other sites, then languages.
MIX_WEIGHTS = {("crawl",): 0.2, ("sites",): 0.8} | {
    (d, lang): w for d in ("crawl", "sites") for lang, w in (("en", 0.4), ("de", 0.2), ("fr", 0.2), ("es", 0.2))
}


def mix_levels() -> dict[str, Column]:
    domain = F.when(F.col("source") == "src0", "crawl").otherwise("sites")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def level_sql(depth: int) -> str:
    """One level of the tree: its nodes with capacity and weight, and their part of the parent's budget."""
    names = ["domain", "lang", "source"]
    here, above = ", ".join(names[:depth]), names[: depth - 1]
    weight = {
        1: "CASE domain WHEN 'crawl' THEN 200000 WHEN 'sites' THEN 800000 ELSE 1000000 END",
        2: "CASE lang WHEN 'en' THEN 400000 WHEN 'de' THEN 200000 WHEN 'fr' THEN 200000 WHEN 'es' THEN 200000 ELSE 1000000 END",
        3: "1000000",
    }[depth]
    same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM b.{c}" for c in above) or "true"
    part = "PARTITION BY " + ", ".join(above) if above else ""
    budget = f"b{depth - 1}"
    return f"""
n{depth} AS (SELECT {here}, sum(cap)::HUGEINT AS cap, ({weight})::HUGEINT AS weight FROM leaf GROUP BY {here}),
o{depth} AS (
  SELECT n.*, b.budget::HUGEINT AS budget,
         coalesce(sum(n.cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
         sum(n.weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS rest
  FROM n{depth} n JOIN {budget} b ON {same}
  WINDOW w AS ({part.replace("BY ", "BY n.").replace(", ", ", n.")} ORDER BY n.cap::DOUBLE / n.weight::DOUBLE, n.{names[depth - 1]})
),
f{depth} AS (SELECT *, before * weight + cap * rest <= budget * weight AS is_full FROM o{depth}),
b{depth} AS (
  SELECT {here}, CASE WHEN is_full THEN cap ELSE
    ((budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER w, 0)::HUGEINT) * weight)
    // nullif(sum(CASE WHEN NOT is_full THEN weight END) OVER w, 0)::HUGEINT END AS budget
  FROM f{depth} WINDOW w AS ({part})
)"""


@query("op7_mixing", r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'sites' END AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS tokens, md5(coalesce(text, '')) AS text_md5
  FROM documents
), leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * 2 AS cap FROM d WHERE tokens > 0 GROUP BY ALL),
b0 AS (SELECT sum(tokens)::HUGEINT // 2 AS budget FROM leaf),"""
+ ",".join(level_sql(i) for i in (1, 2, 3))
+ r""",
r AS (
  SELECT d.*, b.budget // l.tokens AS whole, b.budget % l.tokens AS rest,
         md5('7|' || (b.budget // l.tokens) || '|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.text_md5) AS hash
  FROM d
  JOIN leaf l ON d.domain = l.domain AND d.lang IS NOT DISTINCT FROM l.lang AND d.source IS NOT DISTINCT FROM l.source
  JOIN b3 b ON d.domain = b.domain AND d.lang IS NOT DISTINCT FROM b.lang AND d.source IS NOT DISTINCT FROM b.source
  WHERE d.tokens > 0
), c AS (
  SELECT *, whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY hash ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM r
)
SELECT doc_id, domain, lang, source, tokens, unnest(range(copies::BIGINT)) AS epoch FROM c
""")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, share=0.5, max_epochs=2)
    return taken.select("doc.doc_id", "leaf.*", "tokens", "epoch")


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_url_filter", r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op11_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec, row_number() OVER () AS row
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.vec, b.vec)::BIGINT AS score
  FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, other_id) AS place FROM s WHERE same AND other_id IS DISTINCT FROM anchor_id
), n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.other_id)::INT AS rank
  FROM p JOIN s ON p.row = s.row AND p.place <= 5 AND NOT s.same
       AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return mine_hard_negatives(rows, is_anchor=lambda i: i % 100 == 0)


def crc32_sql(text: str) -> str:
    """CRC-32 of a text, four bits at a time, low half of a byte first."""
    table = list(range(16))
    for _ in range(4):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    halves = f"regexp_extract_all(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), '.')"
    halves = f"list_transform({halves}, lambda x: ('0x' || x)::BIGINT)"
    step = f"xor(c // 16, {table}[xor(c % 16, b) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, b: {step}))"


@query("op12_sharding", f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, text, json_array(source)::VARCHAR AS path,
         md5('12|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS hash
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY hash) - 1 AS rank, count(*) OVER (PARTITION BY path) AS n,
         ('0x' || substr(md5('12|' || path), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS phase
  FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY (rank + phase) / n, path, hash) - 1 AS pos, count(*) OVER () AS total FROM r
)
SELECT doc_id, size, {crc32_sql("coalesce(text, '')")} AS text_crc32, 'rows' AS law, (pos * 16 // total)::INT AS shard,
       pos - ((pos * 16 // total) * total + 15) // 16 AS slot, NULL::INT AS grown_shard
FROM p
""")
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), 16)
    text = F.coalesce(F.col("doc.text").cast("binary"), F.lit(b""))
    return placed.select(
        "doc.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op13_fill_in_middle", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), c AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = [F.sha2(c, 256) for c in (F.col("output"), restored(F.col("output"), F.col("form")))]
    return made.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))
