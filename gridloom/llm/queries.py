"""The operators as queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.byte_bpe import bpe_decode, bpe_digest, bpe_encode
from gridloom.llm.chat import chat_digest, chat_format
from gridloom.llm.decontaminate import find_leaks
from gridloom.llm.divergence import LEAST_DOCS, PRIOR, SCALE, TOP_TERMS, source_divergence
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.license_scan import license_scan
from gridloom.llm.line_dedup import MAX_RATIO, MIN_PAGES, line_dedup
from gridloom.llm.ngram_join import ngram_join
from gridloom.llm.packing import pack
from gridloom.llm.prefix_trie import FAMILY, HEADS, NO_ENDS, prefix_trie
from gridloom.llm.quality import THRESHOLD, score_quality, train_quality
from gridloom.llm.secrets import EXAMPLE_OWNERS, EXAMPLE_REPOS, secret_scan
from gridloom.llm.toxicity import is_training, score_toxicity, train


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("template_spans")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = train(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    return score_toxicity(docs, models).select("doc_id", F.coalesce(~is_training("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_digest(chat_format(rows.unionByName(own)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"), folds=4, held=2)
    return score_quality(docs, model).select("doc_id", F.coalesce(~is_training("doc_id", 4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_digest(bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_packing, op3_line_dedup, op4_exact_dedup, op5_ngram_join, op6_secret_scan, op7_decontamination, op8_toxicity, op9_chat_format, op10_quality, op11_prefix_trie, op12_byte_bpe, op13_source_divergence)}

OP3_SQL = f"""
WITH split AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
rows AS (SELECT row_number() OVER () AS r, * FROM split),
places AS (SELECT DISTINCT r, source, trim(translate(l, chr(9) || chr(13), '  '), ' ') AS l FROM (SELECT r, source, unnest(lines) AS l FROM rows)),
boiler AS (SELECT p.source, p.l FROM places p JOIN pages g ON p.source IS NOT DISTINCT FROM g.source WHERE p.l <> '' GROUP BY p.source, p.l, g.pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO} * g.pages),
drops AS (SELECT r, list(p.l) AS gone FROM places p JOIN boiler b ON p.source IS NOT DISTINCT FROM b.source AND p.l = b.l GROUP BY r),
kept AS (SELECT rows.*, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, trim(translate(x, chr(9) || chr(13), '  '), ' ')), false)) AS stays, gone FROM rows LEFT JOIN drops USING (r))
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(stays, chr(10)), '') END AS text, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stays) AS BIGINT) AS n_dropped FROM kept
"""

OP4_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t
"""

_SPAN_SQL = """
SELECT r, doc_id, source, lang, '{kind}' AS kind, {rank} AS rank, v AS value,
       len(array_to_string(list_concat(gaps[1:i], wholes[1:i - 1]), '')) AS s, len(array_to_string(list_concat(gaps[1:i], wholes[1:i]), '')) AS e
FROM (SELECT *, unnest(vals) AS v, generate_subscripts(vals, 1) AS i FROM (
  SELECT r, doc_id, source, lang, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS wholes, regexp_extract_all(text, '{p}', {group}) AS vals FROM t))
WHERE len(v) >= {least}
"""
_ASSIGN = r"""((?i)password|(?i)passwd|(?i)secret|(?i)token|(?i)api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"""
OP6_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
base AS ({_SPAN_SQL.format(kind="assign", rank=0, p=_ASSIGN, group=2, least=12)} UNION ALL {_SPAN_SQL.format(kind="access", rank=1, p="AKIA[A-Z0-9]+", group=0, least=18)} UNION ALL {_SPAN_SQL.format(kind="hex", rank=2, p="[0-9a-f]+", group=0, least=16)}),
held AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(lang, chr(0)))) AS repos FROM base GROUP BY value),
judged AS (SELECT base.*, owners < {EXAMPLE_OWNERS} AND repos < {EXAMPLE_REPOS} AS live FROM base JOIN held USING (value)),
spans AS (SELECT r, s, rank, e, kind FROM judged UNION SELECT r, e - len(value), 3, e, 'live' FROM judged WHERE live),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS base, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM judged GROUP BY r),
b AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN a USING (r) LEFT JOIN b USING (r)
"""

OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, '<|turn|>' || replace(replace(role, '\', '\\'), '<|', '<\|') || '<|text|>' || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' AS f FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(f)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""



def _crc32_steps() -> list[int]:
    """What four bits more do to a CRC-32."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


# CRC-32 of a number's decimal digits, half a byte at a time.
_DIGITS = "flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) & 15 AS UBIGINT), CAST(ascii(x) >> 4 AS UBIGINT)]))"
_CRC32 = f"xor(list_reduce(list_concat([CAST({0xFFFFFFFF} AS UBIGINT)], {_DIGITS}), lambda a, b: xor(a >> 4, CAST({_crc32_steps()} AS UBIGINT[])[CAST((xor(a, b) & 15) + 1 AS INTEGER)])), CAST({0xFFFFFFFF} AS UBIGINT))"
OP11_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, sha256(strlen(role) || ':' || role || text) AS digest, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, CAST({_CRC32} % {HEADS} AS BIGINT) AS h, list({{'digest': digest, 'words': words}} ORDER BY turn NULLS FIRST, digest) AS turns FROM d GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN c b ON c.base = b.conv_id),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, list_transform(turns, lambda x: x.digest) AS digests, turns FROM r),
m AS (SELECT conv_id, n, depth, array_to_string(digests[1:depth], ',') AS key, CASE WHEN depth > 0 THEN array_to_string(digests[1:depth - 1], ',') END AS parent, CASE WHEN depth > 0 THEN turns[depth].words ELSE 0 END AS words FROM p),
nodes AS (SELECT key, depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY key, depth),
kids AS (SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
full_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.key = k.parent AND (n.depth > 0 OR n.key = '')),
above AS (SELECT DISTINCT m.key, m.depth, a.key AS above, a.depth AS above_depth FROM m JOIN m a ON m.conv_id = a.conv_id AND a.depth <= m.depth),
sums AS (SELECT above, above_depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM above JOIN full_ f ON above.key = f.key AND above.depth = f.depth GROUP BY above, above_depth)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_ f LEFT JOIN full_ q ON f.parent = q.key AND f.depth = q.depth + 1 JOIN sums s ON s.above = f.key AND s.above_depth = f.depth
"""

_SHARE_SQL = f"1 + CAST((CAST({SCALE} AS HUGEINT) * ({{n}} + {PRIOR})) // ({{total}} + {PRIOR} * v) AS BIGINT)"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS BIGINT) AS all_n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS group_n FROM counts GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE_SQL.format(n="coalesce(c.n, 0)", total="coalesce(t.group_n, 0)")} AS p, {_SHARE_SQL.format(n="k.lang_n", total="all_n")} AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN gaps x ON g.lang = x.lang AND g.source = x.source AND o.source = x.item
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

ORACLE_SQL = {"op3_line_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_secret_scan": OP6_SQL, "op9_chat_format": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_source_divergence": OP13_SQL}
