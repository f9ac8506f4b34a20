"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import (
    bpe,
    dual_tree,
    exact_dedup,
    fingerprints,
    html_text,
    licences,
    line_dedup,
    mixing,
    packing,
    prefix_trie,
    quality,
    simhash,
    token_counts,
)
from cuelake.llm.tables import shared_dir

TOKENIZERS = "/opt/tokenizers"
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
COUNTED_BPE = "byte_bpe_50k.json"
CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SEED, CLUSTER_DIMS = 8, 10, 3, 64
MIX_WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
}
MIX_SEED = 17
QUALITY_SEED, QUALITY_LENGTH = 42, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED, carry=("doc_id",))
    return found.select("r.doc_id", "domain", "lang", "source", "tokens", "epoch")


def op2_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_comparison(table(spark, sf_dir, "documents"))


def op3_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    share = quality.good_share(labels)
    return quality.importance_sample(docs, labels, share=share, neutral=0.0, length=QUALITY_LENGTH, seed=QUALITY_SEED)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{BYTE_BPE}")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), carry=("page_id", "url"))
    return found.select("r.page_id", "r.url", "text", "n_chars")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), carry=("doc_id",))
    return found.select("r.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode(docs, f"{TOKENIZERS}/{WORD_BPE}", decoded=True)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(
        table(spark, sf_dir, "embeddings"), k=CLUSTERS, rounds=CLUSTER_ROUNDS, seed=CLUSTER_SEED, dims=CLUSTER_DIMS
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache of this call's own: every distinct text is a miss once."""
    cache = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{COUNTED_BPE}", cache)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_canonical_digest": op2_canonical_digest,
    "op3_importance_sample": op3_importance_sample,
    "op4_licence_scan": op4_licence_scan,
    "op5_packed_ids": op5_packed_ids,
    "op6_main_text": op6_main_text,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_dual_tree": op12_dual_tree,
    "op13_token_counts": op13_token_counts,
}

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _case(level: str) -> str:
    whens = "".join(f" WHEN '{k}' THEN {w}" for k, w in MIX_WEIGHTS.get(level, {}).items())
    return f"CASE {level}{whens} ELSE 1 END" if whens else "1"


def _share_sql(level: str, keys: list[str], known: str) -> str:
    """One level of the tree: the parents' budgets shared among their children."""
    parent, here = ", ".join(keys), ", ".join([*keys, level])
    part = f"PARTITION BY {parent}"
    order = f"{part} ORDER BY capacity / weight, {level}"
    return f"""
        {level}_n AS (SELECT {here}, sum(capacity)::BIGINT AS capacity, sum(tokens)::BIGINT AS tokens, {_case(level)} AS weight
                      FROM leaves GROUP BY {here}),
        {level}_f AS (
          SELECT n.*, k.budget,
                 coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before,
                 sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
          FROM {level}_n n JOIN {known} k USING ({parent})),
        {level}_g AS (SELECT *, capacity * w_left <= (budget - c_before) * weight AS is_full FROM {level}_f),
        {level}_b AS (
          SELECT {here}, tokens,
                 (CASE WHEN is_full THEN capacity
                       ELSE ((budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({part})) * weight)
                            // greatest(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}), 1) END)::BIGINT AS budget
          FROM {level}_g),"""


MIX_SQL = rf"""
    WITH d AS (
      SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 4)
               AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {WORDS_SQL} AS tokens
      FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS capacity, 'root' AS root
               FROM d WHERE tokens > 0 GROUP BY ALL),
    r AS (SELECT 'root' AS root, least(sum(tokens), sum(capacity))::BIGINT AS budget FROM leaves),
    {_share_sql("domain", ["root"], "r")}
    {_share_sql("lang", ["root", "domain"], "domain_b")}
    {_share_sql("source", ["root", "domain", "lang"], "lang_b")}
    p AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM source_b),
    m AS (
      SELECT d.*, p.epochs, p.rest, sum(d.tokens) OVER (
               PARTITION BY d.domain, d.lang, d.source
               ORDER BY sha256('{MIX_SEED}:' || p.epochs || ':' || d.doc_id)) AS running
      FROM d JOIN p USING (domain, lang, source) WHERE d.tokens > 0)
    SELECT doc_id, domain, lang, source, tokens, unnest(range(epochs + CASE WHEN running <= rest THEN 1 ELSE 0 END)) AS epoch
    FROM m
"""

# CRC-32 of c in decimal: one bit a step (-1), after each character is put in.
CRC_SQL = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
                                                            lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""

TRIE_SQL = f"""
    WITH t AS (
      SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    v AS (SELECT c, count(*) AS n, c - c % 5 AS b, {CRC_SQL} % 9 AS h FROM t GROUP BY c),
    m AS (SELECT v.*, least(v.h, coalesce(w.n, 0)) AS taken FROM v LEFT JOIN v w ON w.c = v.b),
    r AS (SELECT m.c, t.pos AS depth, t.role, t.text FROM m JOIN t ON t.c = m.b AND t.pos <= m.h
          UNION ALL
          SELECT m.c, m.taken + t.pos - m.h, t.role, t.text FROM m JOIN t ON t.c = m.c AND t.pos > m.h),
    p AS (SELECT c, depth, strlen(text) AS bytes,
                 sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER (
                   PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node
          FROM r UNION ALL SELECT c, 0, 0, '' FROM m),
    q AS (SELECT *, lag(node) OVER w AS up, depth = max(depth) OVER (PARTITION BY c) AS is_end
          FROM p WINDOW w AS (PARTITION BY c ORDER BY depth)),
    n AS (SELECT node, any_value(up) AS up, min(c) AS conv_id, depth, count(*) AS n_convs,
                 (count(*) - 1) * any_value(bytes) AS cost,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends_sha256
          FROM q GROUP BY node, depth),
    k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
    pairs AS (SELECT DISTINCT a.node, b.node AS below FROM q a JOIN q b ON a.c = b.c AND b.depth >= a.depth),
    s AS (SELECT pairs.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum(n.cost)::BIGINT AS saved_tokens
          FROM pairs JOIN n ON n.node = pairs.below LEFT JOIN k ON k.node = pairs.below GROUP BY pairs.node)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
           s.n_leaves, s.saved_tokens, n.ends_sha256
    FROM n JOIN s ON s.node = n.node LEFT JOIN n u ON u.node = n.up LEFT JOIN k ON k.node = n.node
"""


def _cluster_sql() -> str:
    near = """
        SELECT v.vec_id, v.v, c.j, c.d FROM vecs v JOIN (
          SELECT w.vec_id, c.j, list_sum(list_transform(list_zip(w.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
          FROM vecs w, {0} c) c ON c.vec_id = v.vec_id
        QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY c.d, c.j) = 1"""
    steps = f"""
    WITH vecs AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {CLUSTER_DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {CLUSTER_DIMS}),
    c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY h) - 1 AS j, v
      FROM (SELECT sha256('{CLUSTER_SEED}:' || vec_id) AS h, v FROM vecs ORDER BY h LIMIT {CLUSTERS})),"""
    for i in range(CLUSTER_ROUNDS):
        steps += f"""
    a{i} AS MATERIALIZED ({near.format(f"c{i}")}),
    m{i} AS (SELECT j, list(x ORDER BY dim) AS v FROM (
               SELECT j, dim, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
               FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM a{i}) GROUP BY j, dim) GROUP BY j),
    c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j),"""
    return steps + f"""
    last AS ({near.format(f"c{CLUSTER_ROUNDS}")})
    SELECT vec_id, l.j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY l.j)::BIGINT AS cluster_inertia,
           sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM last l JOIN c{CLUSTER_ROUNDS} c ON c.j = l.j
"""


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": f"""
        WITH l AS (
          SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
        k AS (
          SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPER_LOWER}) AS key
          FROM l),
        g AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.keep AS gone FROM k LEFT JOIN g ON k.key = g.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op1_source_mix": MIX_SQL,
    "op11_prefix_trie": TRIE_SQL,
    "op12_dual_tree": _cluster_sql(),
    "op7_exact_dedup": f"""
        WITH t AS (
          SELECT doc_id, translate(coalesce(text, ''), {UPPER_LOWER}) AS norm FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
}
