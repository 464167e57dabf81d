"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corelode.llm import quality, toxicity
from corelode.llm.decontaminate import contained_items
from corelode.llm.exact_dedup import exact_groups
from corelode.llm.importance import resample
from corelode.llm.line_dedup import dedup_lines
from corelode.llm.mixing import mix
from corelode.llm.near_dedup import near_duplicates
from corelode.llm.packing import pack
from corelode.llm.preferences import format_preferences, stale_answers
from corelode.llm.sharding import SLOTS, lookup_table, with_shard
from corelode.llm.url_filter import judge_sql, judge_urls
from corelode.llm.vector_codes import compress


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return with_shard(table(spark, folder, "documents")).select("doc_id", "slot", "shard")


OP2_SQL = f"""SELECT doc_id, slot, CAST({lookup_table()}[slot + 1] AS INTEGER) AS shard FROM
 (SELECT doc_id, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 15) AS BIGINT) % {SLOTS} AS slot FROM documents)"""


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# Shingle sets of a table in DuckDB's SQL: tokens, then five-word shingles.
SETS_SQL = r"""{name}_tokens AS (SELECT {id},
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
{name}_sets AS MATERIALIZED (SELECT {id}, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM {name}_tokens),
{name}_items AS MATERIALIZED (SELECT {id}, len(s) AS n, unnest(s) AS x FROM {name}_sets)"""

OP3_SQL = f"""WITH {SETS_SQL.format(name="doc", id="doc_id", table="documents")},
{SETS_SQL.format(name="bench", id="item_id", table="(SELECT DISTINCT item_id, text FROM benchmark)")}
SELECT doc_id, item_id, bench_items.n AS item_shingles, count(*) AS shared_shingles FROM doc_items JOIN bench_items USING (x)
GROUP BY doc_id, item_id, bench_items.n HAVING 100 * count(*) >= 75 * bench_items.n"""

# The rules of the deployment, as given: (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), URL_RULES)


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"), keep="largest")


OP5_SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


OP6_SQL = r"""WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS MATERIALIZED (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM parts),
firsts AS MATERIALIZED (SELECT line, string_split(line, ' ') AS w, row_number() OVER (ORDER BY doc_id, no) AS pos, doc_id, no FROM
 (SELECT line, min(doc_id) AS doc_id, arg_min(no, doc_id * 1000000 + no) AS no FROM lines WHERE len(string_split(line, ' ')) >= 4 GROUP BY line)),
long AS (SELECT pos, w FROM firsts WHERE len(w) >= 8),
gaps AS (SELECT pos, w, unnest(range(1, len(w) + 1)) AS i FROM long),
variants AS MATERIALIZED (SELECT pos, i, md5(array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ')) AS v FROM gaps
 UNION ALL SELECT pos, 0, md5(array_to_string(w, ' ')) FROM long),
changed AS (SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY v, i) AS least FROM variants WHERE i > 0) WHERE least < pos),
shorter AS (SELECT a.pos AS a, b.pos AS b FROM variants a JOIN variants b ON a.v = b.v WHERE a.i > 0 AND b.i = 0),
near AS (SELECT pos FROM changed UNION SELECT greatest(a, b) FROM shorter),
judged AS (SELECT lines.doc_id, lines.no, lines.line, coalesce(near.pos IS NOT NULL OR (lines.doc_id, lines.no) > (firsts.doc_id, firsts.no), false) AS gone
 FROM lines LEFT JOIN firsts USING (line) LEFT JOIN near USING (pos))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text, CAST(count(*) AS INTEGER) AS n_lines,
 CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_dropped FROM judged GROUP BY doc_id"""


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, folder, "labels")))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.grade_documents(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


OP9_SQL = f"""WITH RECURSIVE {SETS_SQL.format(name="doc", id="doc_id", table="documents")},
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM doc_items a JOIN doc_items b USING (x) WHERE a.doc_id <> b.doc_id
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc_sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s) AS n_shingles, m AS component_id, doc_id = m AS kept FROM doc_sets JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id"""


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    pairs = format_preferences(turns, stale_answers(turns), pair="conv_id")
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"], s["end"])), ",") for c in ("chosen_spans", "rejected_spans")}
    return pairs.withColumnRenamed("pair_id", "conv_id").withColumns(spans)


OP10_SQL = r"""WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
marked AS (SELECT *, row_number() OVER o AS place,
 last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answer,
 last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said
 FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
bounds AS (SELECT *, max(CASE WHEN role = 'assistant' THEN place END) OVER (PARTITION BY conv_id) AS final FROM marked),
sides AS (SELECT conv_id, place, role, text AS c, CASE WHEN place = final THEN coalesce(answer, said) ELSE text END AS r FROM bounds WHERE final IS NOT NULL),
cut AS (SELECT *, coalesce(min(CASE WHEN coalesce(c, '') <> coalesce(r, '') THEN place END) OVER (PARTITION BY conv_id), 1 + max(place) OVER (PARTITION BY conv_id)) AS p FROM sides),
shown AS (SELECT conv_id, place, p, role, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head,
 coalesce(c, '') || '<|end|>' || chr(10) AS c, coalesce(r, '') || '<|end|>' || chr(10) AS r FROM cut),
measured AS (SELECT *, sum(CASE WHEN place >= p THEN length(head) + length(c) END) OVER o AS c_end, sum(CASE WHEN place >= p THEN length(head) + length(r) END) OVER o AS r_end
 FROM shown WINDOW o AS (PARTITION BY conv_id ORDER BY place))
SELECT conv_id, CAST(any_value(p) - 1 AS INTEGER) AS prompt_turns, coalesce(string_agg(head || c, '' ORDER BY place) FILTER (WHERE place < p), '') AS prompt,
 coalesce(string_agg(head || c, '' ORDER BY place) FILTER (WHERE place >= p), '') AS chosen,
 coalesce(string_agg(head || r, '' ORDER BY place) FILTER (WHERE place >= p), '') AS rejected,
 coalesce(string_agg((c_end - length(c)) || '-' || c_end, ',' ORDER BY place) FILTER (WHERE place >= p AND role = 'assistant'), '') AS chosen_spans,
 coalesce(string_agg((r_end - length(r)) || '-' || r_end, ',' ORDER BY place) FILTER (WHERE place >= p AND role = 'assistant'), '') AS rejected_spans
FROM measured GROUP BY conv_id"""

def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress(table(spark, folder, "embeddings"))


def _op11_sql(rounds: int = 2) -> str:
    """Every round compares every part with every entry of its codebook."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""found{k} AS MATERIALIZED (SELECT r, p, min(d * 64 + e) AS best FROM (SELECT r, parts.p, e,
 list_sum([CAST(t * t AS BIGINT) FOR t IN [part[i] - entry[i] FOR i IN range(1, len(part) + 1)]]) AS d FROM parts JOIN book{k} USING (p)) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""sums{k} AS (SELECT p, best % 64 AS e, i, floor(sum(x) / count(*)) AS mean FROM (SELECT p, best, unnest(part) AS x, unnest(range(len(part))) AS i
 FROM parts JOIN found{k} USING (r, p)) GROUP BY ALL),
means{k} AS (SELECT p, e, list(CAST(mean AS BIGINT) ORDER BY i) AS entry FROM sums{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(means{k}.entry, book{k}.entry) AS entry FROM book{k} LEFT JOIN means{k} USING (p, e))""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
 FROM embeddings WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS part FROM kept, (SELECT unnest(range(16)) AS p)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
book0 AS MATERIALIZED (SELECT p, e, part AS entry FROM parts JOIN seeds USING (r)),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM found{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM kept JOIN coded USING (r)"""


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# CRC-32 of a word from its bytes: a table of the 256 byte values, then one step a byte.
OP13_SQL = r"""WITH crc_table AS MATERIALIZED (SELECT list(list_reduce(list_concat([v], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY v) AS t FROM range(256) s(v)),
texts AS (SELECT 'doc' AS side, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'bench', 0, text FROM benchmark),
words AS MATERIALIZED (SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
buckets AS MATERIALIZED (SELECT w, xor(list_reduce(list_concat([4294967295], [CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(len(h) // 2)]),
 lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM words), crc_table),
found AS MATERIALIZED (SELECT side, r, b, count(*) AS n FROM words JOIN buckets USING (w) GROUP BY side, r, b),
rates AS (SELECT b, CAST(coalesce(sum(n) FILTER (WHERE side = 'doc'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE side = 'bench'), 0) AS DOUBLE) AS t FROM found GROUP BY b),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM rates) + 10000) / ((s + 1) * ((SELECT sum(t) FROM rates) + 10000)))) AS BIGINT) AS gain FROM rates),
docs AS (SELECT row_number() OVER () AS r, doc_id FROM documents),
weighed AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM found JOIN gains USING (b) WHERE side = 'doc' GROUP BY r),
scored AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
 CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h FROM docs LEFT JOIN weighed USING (r)),
judged AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score, n_features >= 20 AS able FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY able) * 10 // 100 AS draw FROM judged)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= draw THEN place END AS rank FROM placed"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_near_dedup": op9_near_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_vector_codes": op11_vector_codes,
    "op12_mixing": op12_mixing,
    "op13_importance": op13_importance,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op4_url_filter": judge_sql(URL_RULES),
    "op5_exact_dedup": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_near_dedup": OP9_SQL,
    "op10_chat_format": OP10_SQL,
    "op11_vector_codes": _op11_sql(),
    "op13_importance": OP13_SQL,
}
