"""Registered queries of the corpus operators, with DuckDB SQL where SQL can express the result.

Each query applies its operator, with production parameters, to the whole
intended table and returns the whole result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_path

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, which DuckDB has no function for: eight steps per byte."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    return (f"xor(4294967295, list_reduce(list_concat([4294967295], {steps}), lambda c, b: "
            "xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)))")


@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens
    return count_tokens(read_table(spark, sf_dir, "documents"), shared_path(spark, "token-files"))


@register("op3_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup
    return exact_dedup(read_table(spark, sf_dir, "documents"))


@register("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    return pack_documents(read_table(spark, sf_dir, "documents"), plain_specials=False)


@register("op6_token_ids")
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair_tokens import read_token_ids, write_token_ids
    path = shared_path(spark, "token-ids")
    write_token_ids(read_table(spark, sf_dir, "documents"), path, plain_specials=False)
    return read_token_ids(spark, path)


@register("op9_source_mixing")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources
    return mix_sources(read_table(spark, sf_dir, "documents"))


@register("op10_line_dedup", r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.last_doc AS gone
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines
    return dedup_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_classes
    return near_classes(read_table(spark, sf_dir, "documents"))


@register("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify
    return identify(read_table(spark, sf_dir, "documents"))


@register("op8_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, w FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, v.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.query_id AND len(v.w) = len(q.w)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_k import top_k
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan
    return scan(read_table(spark, sf_dir, "documents"))


# Every 8 consecutive nodes of a group become one, level by level; then a row's digest is folded with its siblings' digests.
_MERKLE_UP = """SELECT grp, lvl + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), any_value(total + 7) // 8
  FROM {0} WHERE total > 1 GROUP BY grp, lvl, i // 8"""
_MERKLE_RUNS = """SELECT grp, lvl, i // 8 AS run, list(digest ORDER BY i) AS ds
  FROM {0} WHERE total > 1 GROUP BY grp, lvl, i // 8"""
_MERKLE_FOLD = """SELECT f.row, f.grp, f.lvl + 1, f.i // 8,
    sha256(array_to_string(list_concat(ds[1:f.i % 8], [f.digest], ds[f.i % 8 + 2:]), '')),
    f.proof || array_to_string(list_concat(ds[1:f.i % 8], ds[f.i % 8 + 2:]), '')
  FROM {0} f JOIN {1} r ON r.grp = f.grp AND r.lvl = f.lvl AND r.run = f.i // 8"""


def _merkle_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(concat(" + ", ".join(
        f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + "))"


@register("op13_merkle_manifest", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS grp, {_merkle_leaf("text")} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0
              THEN {_merkle_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents),
n AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY grp) AS total
  FROM d),
up(grp, lvl, i, digest, total) AS (SELECT grp, 0, i, leaf, total FROM n UNION ALL {_MERKLE_UP.format("up")}),
subs AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS total FROM up WHERE total = 1),
top(grp, lvl, i, digest, total) AS (
  SELECT 0, 0, i, subroot, total FROM subs UNION ALL {_MERKLE_UP.format("top")}),
runs AS ({_MERKLE_RUNS.format("up")}),
top_runs AS ({_MERKLE_RUNS.format("top")}),
f(row, grp, lvl, i, digest, proof) AS (
  SELECT row, grp, 0, i, coalesce(tampered, leaf), '' FROM n UNION ALL {_MERKLE_FOLD.format("f", "runs")}),
ended AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY row ORDER BY lvl DESC) = 1),
g(row, grp, lvl, i, digest, proof) AS (
  SELECT e.row, 0, 0, s.i, e.digest, e.proof FROM ended e JOIN subs s ON s.grp = e.grp
  UNION ALL {_MERKLE_FOLD.format("g", "top_runs")}),
folded AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY row ORDER BY lvl DESC) = 1)
SELECT n.doc_id, n.leaf, s.subroot, t.digest AS root, sha256(o.proof) AS proof_sha256, o.digest AS folded_root,
       o.digest = t.digest AS verified
FROM n JOIN subs s ON s.grp = n.grp JOIN folded o ON o.row = n.row JOIN top t ON t.total = 1""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest
    return manifest(read_table(spark, sf_dir, "documents"))


@register("op12_conversation_trie", f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t),
r AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM r),
p AS (
  SELECT conv_id, depth, length(text) AS chars,
         string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
           OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
k AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM p),
n AS (
  SELECT depth, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM k GROUP BY depth, key),
kids AS (SELECT parent AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, key)),
sub AS (
  SELECT k.depth, k.key, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
  FROM v JOIN k ON k.conv_id = v.conv_id AND k.depth <= v.depth GROUP BY k.depth, k.key)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, sub.n_leaves,
       CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN sub ON sub.depth = v.depth AND sub.key = v.key LEFT JOIN v up ON up.depth = v.depth - 1 AND up.key = v.parent""")
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conv_trie import conversation_trie
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


@register("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
