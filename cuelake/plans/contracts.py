"""Queries over row contracts of resumable work."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.operators import caching, contracts, sampling
from cuelake.operators import segments as sg
from cuelake.plans.corpus import LABELLED, labelled
from cuelake.plans.media import KEY
from cuelake.plans.registry import Plans
from cuelake.plans.segments import WORDS
from cuelake.plans.summaries import SECONDS
from cuelake.sources.tables import cues, table

P = Plans()


@P.add(
    "alignment_windows",
    """
    , d AS (SELECT cue_id, CASE WHEN cue_id % 3 = 0 THEN 0 ELSE end_ms - start_ms - 50 END AS r, end_ms - start_ms AS c, CASE WHEN cue_id % 4 = 0 THEN NULL ELSE 100 END AS b, cue_id % 3000 AS e FROM cues),
    w AS (SELECT *, CASE WHEN r > 0 THEN r ELSE greatest(0, c) END AS w FROM d), s AS (SELECT *, greatest(0, CASE WHEN b IS NULL THEN w ELSE least(b, w) END) AS s FROM w),
    t AS (SELECT *, greatest(s, least(e, w)) AS t FROM s)
    SELECT cue_id, CASE WHEN t - s >= 50 THEN s ELSE 0 END AS start_ms, CASE WHEN t - s >= 50 THEN t ELSE w END AS end_ms, CASE WHEN t - s >= 50 THEN 'given' ELSE 'chunk' END AS source FROM t""",
    over_cues=True,
)
def alignment_windows(spark, sf):
    d = F.col("end_ms") - F.col("start_ms")
    window = contracts.alignment_window(
        F.when(F.col("cue_id") % 3 == 0, 0).otherwise(d - 50), d, F.when(F.col("cue_id") % 4 != 0, F.lit(100).cast("long")), F.col("cue_id") % 3000
    )
    return cues(spark, sf).select("cue_id", window.alias("w")).select("cue_id", "w.*")


@P.add(
    "alignment_outcomes",
    WORDS + f""", t AS (SELECT cue_id, count(*) AS word_count, count(*) FILTER (WHERE end_ms <= start_ms) AS no_length, count(*) FILTER (WHERE end_ms - start_ms <= 80) AS tiny FROM words GROUP BY cue_id)
    SELECT c.cue_id, coalesce(word_count, 0) AS word_count, coalesce(no_length, 0) AS no_length, coalesce(tiny, 0) AS tiny,
           CASE WHEN length({KEY}) = 0 THEN 'nonlexical' WHEN end_ms - start_ms < 300 THEN 'drop_or_review' WHEN c.cue_id % 10 / 10 < 0.5 THEN 'partial' WHEN coalesce(no_length, 0) > 0 THEN 'boundary' ELSE 'aligned' END AS quality
    FROM cues c LEFT JOIN t USING (cue_id)""",
    over_cues=True,
)
def alignment_outcomes(spark, sf):
    c = cues(spark, sf)
    return contracts.outcomes(c, sg.words(c), F.length(tx.compact(F.col("src_text"))), (F.col("cue_id") % 10) / 10)


@P.add(
    "placeholders",
    "SELECT d.doc_id, d.lang, coalesce(b.text, '') AS text, b.item_id IS NULL AS placeholder FROM documents d LEFT JOIN (SELECT DISTINCT item_id, text FROM benchmark) b ON b.item_id = d.doc_id",
)
def placeholders(spark, sf):
    results = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text").distinct()
    return contracts.with_placeholders(table(spark, sf, "documents").select("doc_id", "lang"), results, "doc_id", "text")


@P.add(
    "restored_results",
    "SELECT conv_id, turn, coalesce(nullif(role, 'user'), 'und') AS language, list_concat([text], ['restored:' || conv_id || '/' || turn]) AS log, length(text) AS chars FROM conversations",
)
def restored_results(spark, sf):
    """Results from a cache: defaults filled, one more line in the log."""
    line = F.concat(F.lit("restored:"), "conv_id", F.lit("/"), "turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.coalesce(F.nullif("role", F.lit("user")), F.lit("und")).alias("language"),
        F.concat(F.array("text"), F.array(line)).alias("log"), F.length("text").cast("long").alias("chars"),
    )


@P.add(
    "config_signatures",
    """
    SELECT doc_id, substr(sha1(array_to_string(list_filter([CASE WHEN doc_id % 3 <> 0 THEN 'beam=' || (doc_id % 3) END, 'lang=' || coalesce(lang, ''), 'model=' || coalesce(source, '')], lambda x: x IS NOT NULL), chr(10))), 1, 12) AS signature
    FROM documents""",
)
def config_signatures(spark, sf):
    settings = {"model": F.col("source"), "lang": F.col("lang"), "beam": F.col("doc_id") % 3}
    return table(spark, sf, "documents").select("doc_id", contracts.config_signature(settings, {"beam": 0}).alias("signature"))


@P.add("compact_vectors", "SELECT vec_id, label, len(embedding) AS n_values FROM embeddings")
def compact_vectors(spark, sf):
    """Without the large column, but for its size."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("n_values"))


@P.add(
    "limit_warnings",
    """
    , m AS (SELECT media_id, count(*) AS n_cues, max(end_ms - start_ms) AS longest_ms, count(*) FILTER (WHERE tgt_text = '') / count(*) AS empty_ratio FROM cues GROUP BY media_id),
    u AS (SELECT media_id, 'n_cues' AS metric, n_cues::DOUBLE AS value, 60.0::DOUBLE AS "limit" FROM m UNION ALL SELECT media_id, 'longest_ms', longest_ms, 9150.0 FROM m UNION ALL SELECT media_id, 'empty_ratio', empty_ratio, 0.04 FROM m)
    SELECT * FROM u WHERE value > "limit\"""",
    over_cues=True,
)
def limit_warnings(spark, sf):
    m = cues(spark, sf).groupBy("media_id").agg(
        F.count(F.lit(1)).alias("n_cues"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"),
        (F.count_if(F.col("tgt_text") == "") / F.count(F.lit(1))).alias("empty_ratio"),
    )
    return contracts.over_limits(m, "media_id", {"n_cues": 60, "longest_ms": 9150, "empty_ratio": 0.04})


ERROR = "event_type || ' ' || (400 + event_id % 150) || CASE event_id % 7 WHEN 0 THEN ' Timed out' WHEN 1 THEN ' rate limit' ELSE '' END"


@P.add(
    "retryable_errors",
    rf"""
    WITH e AS (SELECT user_id, lower({ERROR}) AS error FROM events)
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(error, '\b(429|5[0-9][0-9])\b|time[d]?[ -]?out|rate limit|connection')) AS retryable FROM e GROUP BY user_id""",
)
def retryable_errors(spark, sf):
    retry = contracts.is_retryable(F.expr(ERROR))
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(retry).alias("retryable"))


LOG = "CASE WHEN doc_id % 5 = 0 THEN {a}lang, 'TIMEOUT:' || source, ''{b} WHEN doc_id % 2 = 0 THEN {a}'timeout:', source{b} ELSE {a}lang{b} END"


@P.add("timed_out", f"SELECT doc_id, coalesce(list_bool_or(list_transform({LOG.format(a='[', b=']')}, lambda x: contains(coalesce(x, ''), 'TIMEOUT:'))), false) AS timed_out FROM documents")
def timed_out(spark, sf):
    log = F.transform(F.expr(LOG.format(a="array(", b=")")), tx.text)
    return table(spark, sf, "documents").select("doc_id", contracts.is_timed_out(log).alias("timed_out"))


@P.add(
    "repetition_loops",
    """
    WITH w AS (SELECT doc_id, string_split(text || CASE doc_id % 4 WHEN 0 THEN ' x x x' WHEN 1 THEN ' a b a b a b' ELSE '' END, ' ') AS w FROM documents), s AS (SELECT *, len(w) AS n FROM w)
    SELECT doc_id, CASE WHEN n >= 3 AND w[n] = w[n-1] AND w[n] = w[n-2] THEN 1 WHEN n >= 6 AND w[n-1:n] = w[n-3:n-2] AND w[n-1:n] = w[n-5:n-4] THEN 2
           WHEN n >= 9 AND w[n-2:n] = w[n-5:n-3] AND w[n-2:n] = w[n-8:n-6] THEN 3 WHEN n >= 12 AND w[n-3:n] = w[n-7:n-4] AND w[n-3:n] = w[n-11:n-8] THEN 4 ELSE 0 END AS loop FROM s""",
)
def repetition_loops(spark, sf):
    more = F.when(F.col("doc_id") % 4 == 0, " x x x").when(F.col("doc_id") % 4 == 1, " a b a b a b").otherwise("")
    words = table(spark, sf, "documents").select("doc_id", F.split(F.concat("text", more), " ").alias("w"))
    return words.select("doc_id", contracts.repetition_loop(F.col("w")).alias("loop"))


@P.add(
    "truncated_rows",
    "SELECT doc_id, len(string_split(text, ' ')) >= 50 + doc_id % 100 AND NOT list_has_any(string_split(text, ' '), ['the', 'der']) AS truncated FROM documents",
)
def truncated_rows(spark, sf):
    words = F.split("text", " ")
    return table(spark, sf, "documents").select("doc_id", contracts.truncated(words, ["the", "der"], 50 + F.col("doc_id") % 100).alias("truncated"))


@P.add(
    "missing_settings",
    "SELECT doc_id, list_filter([CASE WHEN coalesce(trim(lang, ' '), '') = '' OR doc_id % 3 = 0 THEN 'lang' END, CASE WHEN coalesce(source, '') = '' OR doc_id % 5 = 0 THEN 'source' END], lambda x: x IS NOT NULL) AS missing FROM documents",
)
def missing_settings(spark, sf):
    lang, source = F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    names = F.array(*(F.when(F.btrim(tx.text(c)) == "", n) for c, n in ((lang, "lang"), (source, "source"))))
    return table(spark, sf, "documents").select("doc_id", F.filter(names, lambda x: x.isNotNull()).alias("missing"))


@P.add(
    "shard_offsets",
    """
    WITH p AS (SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS shard FROM documents)
    SELECT source, doc_id, shard, coalesce(sum(n_chars) OVER (PARTITION BY source, shard ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM p""",
)
def shard_offsets(spark, sf):
    return contracts.shard_offsets(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 10)


@P.add(
    "clipped_spans",
    """
    , c AS (SELECT media_id, cue_id, greatest(0, least(start_ms, 300000)) AS s, greatest(0, least(end_ms, 300000)) AS e2 FROM cues)
    SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY s, e2, cue_id) - 1 AS pos, s AS start_ms, e2 AS end_ms FROM c WHERE e2 > s""",
    over_cues=True,
)
def clipped_spans(spark, sf):
    return contracts.clipped(cues(spark, sf), "media_id", 300_000)


@P.add(
    "word_containment",
    WORDS + """, k AS (SELECT cue_id, start_ms + 300 AS c0, end_ms - 300 AS c1 FROM cues)
    SELECT cue_id, count(*) FILTER (WHERE start_ms + end_ms < 2 * c0) AS before, count(*) FILTER (WHERE start_ms + end_ms BETWEEN 2 * c0 AND 2 * c1) AS inside,
           count(*) FILTER (WHERE start_ms + end_ms > 2 * c1) AS after FROM words JOIN k USING (cue_id) GROUP BY cue_id""",
    over_cues=True,
)
def word_containment(spark, sf):
    c = cues(spark, sf)
    cores = c.select("cue_id", (F.col("start_ms") + 300).alias("start_ms"), (F.col("end_ms") - 300).alias("end_ms"))
    return contracts.containment(sg.words(c), cores, "cue_id")


@P.add(
    "event_fragments",
    "SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last, count(DISTINCT event_type) AS kinds, arg_min(event_type, event_id) AS first_text FROM events WHERE event_type IN ('error', 'view') GROUP BY user_id",
)
def event_fragments(spark, sf):
    """Events of two phases only, compacted to a row a job."""
    return contracts.fragments(table(spark, sf, "events").where(F.col("event_type").isin("error", "view")), "user_id", "event_id", "event_type")


@P.add(
    "oversampled_domains",
    f"SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT lang, n_chars, unnest(range(CASE WHEN quality = 1 THEN 3 ELSE 1 END)) AS turn FROM ({LABELLED})) GROUP BY lang",
)
def oversampled_domains(spark, sf):
    rows = contracts.oversampled(labelled(spark, sf), F.when(F.col("quality") == 1, 3).otherwise(1))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@P.add("stable_ids", "SELECT doc_id, regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', '-', 'g') || '-train-' || printf('%06d', doc_id) AS id FROM documents")
def stable_ids(spark, sf):
    name = F.regexp_replace(F.lower(tx.text(F.col("source"))), "[^a-z0-9]+", "-")
    return table(spark, sf, "documents").select("doc_id", F.format_string("%s-train-%06d", name, "doc_id").alias("id"))


@P.add("host_refs", r"SELECT page_id, list_distinct(regexp_extract_all(html, 'href=\"/?([^\"]*)\"', 1)) IS NOT NULL AS has_refs, len(list_distinct(regexp_extract_all(html, 'href=\"/?([^\"]*)\"', 1))) AS refs, regexp_extract(html, 'href=\"/?([^\"]*)\"', 1) AS first_ref FROM pages")
def host_refs(spark, sf):
    """References of a page: how many different ones, and the first."""
    refs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="/?([^"]*)"'), 1))
    return table(spark, sf, "pages").select(
        "page_id", refs.isNotNull().alias("has_refs"), F.size(refs).cast("long").alias("refs"), F.coalesce(F.get(refs, F.lit(0)), F.lit("")).alias("first_ref")
    )


@P.add(
    "loaded_jobs",
    f"""
    WITH j AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max({SECONDS}) AS at_s FROM events WHERE event_type IS NOT NULL GROUP BY user_id)
    SELECT user_id, CASE WHEN state IN ('view', 'click') THEN 'failed' ELSE state END AS state, state IN ('view', 'click') AS rewritten, at_s FROM j""",
)
def loaded_jobs(spark, sf):
    """Jobs as they stand after a restart: active ones have failed."""
    s = F.expr("unix_micros(cast(ts as timestamp)) div 1000000L")
    jobs = table(spark, sf, "events").where("event_type is not null").groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max(s).alias("at_s")
    )
    active = F.col("state").isin("view", "click")
    return jobs.select("user_id", F.when(active, "failed").otherwise(F.col("state")).alias("state"), active.alias("rewritten"), "at_s")


@P.add(
    "source_plans",
    f"""
    WITH u AS (SELECT 'documents' AS plan, lang AS kind, length(text) AS n FROM documents UNION ALL SELECT 'conversations', role, length(text) FROM conversations UNION ALL SELECT 'benchmark', 'item', length(text) FROM benchmark)
    SELECT plan, kind, count(*) AS rows, sum(n)::BIGINT AS chars FROM u WHERE n > 0 GROUP BY ALL""",
)
def source_plans(spark, sf):
    """Several sources in one shape, summed up per source and kind."""
    shape = lambda name, kind: table(spark, sf, name).select(F.lit(name).alias("plan"), kind.alias("kind"), F.length("text").alias("n"))
    union = shape("documents", F.col("lang")).unionByName(shape("conversations", F.col("role"))).unionByName(shape("benchmark", F.lit("item")))
    return union.where("n > 0").groupBy("plan", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars"))


@P.add(
    "split_counters",
    """
    WITH k AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents WHERE length(text) >= 200)
    SELECT source, CASE WHEN pos <= 2 THEN 'val' WHEN pos <= 4 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM k WHERE pos <= 20 GROUP BY ALL""",
)
def split_counters(spark, sf):
    """Only kept rows take positions; then rows per source and split."""
    kept = table(spark, sf, "documents").where(F.length("text") >= 200).select("source", "doc_id")
    split = sampling.positional_split(kept, "source", "doc_id", 2, 2, 16)
    return split.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@P.add(
    "item_digests",
    "SELECT DISTINCT sha256(text) AS digest, substr(sha256(text), 1, 12) AS id, length(text) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) WHERE text IS NOT NULL",
)
def item_digests(spark, sf):
    """Items of two sources by content, each once."""
    both = table(spark, sf, "documents").select("text").union(table(spark, sf, "benchmark").select("text")).where("text is not null")
    digest = F.sha2("text", 256)
    return both.select(digest.alias("digest"), F.substring(digest, 1, 12).alias("id"), F.length("text").cast("long").alias("n")).distinct()


@P.add(
    "input_summary",
    "SELECT coalesce(lang, '') AS lang, count(*) AS rows, max(doc_id) AS latest, bit_xor(('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT) AS digest FROM documents GROUP BY 1",
)
def input_summary(spark, sf):
    """Rows, latest id and an order-free digest of the texts, by language."""
    part = F.conv(F.substring(F.md5(tx.text(F.col("text"))), 1, 15), 16, 10).cast("long")
    return table(spark, sf, "documents").groupBy(tx.text(F.col("lang")).alias("lang")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("latest"), F.bit_xor(part).alias("digest")
    )


@P.add(
    "undeclared_options",
    """
    SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l, (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s
    WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = l.lang AND d.source = s.source AND d.n_chars > 1500)""",
)
def undeclared_options(spark, sf):
    """Combinations of two short axes that no row declares: one axis is a literal list in every row of the other."""
    docs = table(spark, sf, "documents").select("lang", "source", "n_chars")
    langs = [r[0] for r in docs.select("lang").where("lang is not null").distinct().collect()]  # languages: a short axis
    sources = docs.select("source").where("source is not null").distinct()
    grid = sources.withColumn("lang", F.explode(F.array(*(F.lit(x) for x in langs)).cast("array<string>")))
    return grid.join(docs.where("n_chars > 1500"), ["lang", "source"], "left_anti").select("lang", "source")


@P.add(
    "span_items",
    """
    SELECT media_id, start_ms, end_ms, substr(sha256(media_id || chr(0) || start_ms || chr(0) || end_ms), 1, 24) AS item_id FROM cues
    WHERE tgt_text <> '' AND end_ms - start_ms >= 2000""",
    over_cues=True,
)
def span_items(spark, sf):
    """Spans with a translation and at least two seconds, with ids from their content."""
    rows = cues(spark, sf).where((F.col("tgt_text") != "") & (F.col("end_ms") - F.col("start_ms") >= 2000))
    return rows.select("media_id", "start_ms", "end_ms", caching.row_key(F.col("media_id"), F.col("start_ms"), F.col("end_ms")).alias("item_id"))


@P.add(
    "inner_candidates",
    "SELECT vec_id, list_filter(embedding, lambda x: x > -0.5 AND x < 0.5) AS inside, list_sort(list_distinct(list_transform(list_concat([1, label], [label, 3]), lambda x: x::INTEGER))) AS positions FROM embeddings",
)
def inner_candidates(spark, sf):
    """The values of an array within a window, and the sorted union of two position lists."""
    label = F.col("label").cast("int")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.filter("embedding", lambda x: (x > -0.5) & (x < 0.5)).alias("inside"),
        F.array_sort(F.array_union(F.array(F.lit(1), label), F.array(label, F.lit(3)))).alias("positions"),
    )
