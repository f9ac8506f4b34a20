"""Queries over documents, labels, conversations and embeddings: text, caches, samples, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.operators import caching, flags, sampling, stats
from cuelake.plans.media import GLOSSARY, _clean, _distinct, _units
from cuelake.plans.registry import Plans
from cuelake.sources.tables import cues, table

P = Plans()
LABELLED = "SELECT d.doc_id, source, lang, quality, toxic, n_chars FROM documents d JOIN labels l USING (doc_id)"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def labelled(spark, sf):
    return table(spark, sf, "documents").drop("text").join(table(spark, sf, "labels"), "doc_id")


@P.add(
    "text_features",
    f"""
    WITH t AS (SELECT doc_id, {_clean("text")} AS shown FROM documents),
    s AS (SELECT *, regexp_replace(shown, '{tx.PUNCTUATION}', '', 'g') AS short FROM t)
    SELECT doc_id, sha1(shown) AS text_sha1, length(short) AS char_count, {_distinct("short")} AS unique_chars,
           {_count("short", tx.KANA)} AS kana_chars, {_count("short", tx.KANJI)} AS kanji_chars, {_count("short", tx.LATIN)} AS latin_chars,
           {_distinct("short")} / greatest(length(short), 1) AS unique_ratio
    FROM s""",
)
def text_features(spark, sf):
    shown = tx.clean(F.col("text"))
    t = table(spark, sf, "documents").select("doc_id", shown.alias("shown"), tx.strip_punctuation(shown).alias("short"))
    n, u = F.length("short"), tx.distinct_chars(F.col("short"))
    return t.select(
        "doc_id", F.sha1("shown").alias("text_sha1"), n.cast("long").alias("char_count"), u.alias("unique_chars"),
        tx.count_of(F.col("short"), tx.KANA).alias("kana_chars"), tx.count_of(F.col("short"), tx.KANJI).alias("kanji_chars"),
        tx.count_of(F.col("short"), tx.LATIN).alias("latin_chars"), (u / F.greatest(n, F.lit(1))).alias("unique_ratio"),
    )


@P.add(
    "char_class_counts",
    rf"""
    SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS chars, sum({_count("text", "[0-9A-Za-z]")})::BIGINT AS latin,
           sum(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')))::BIGINT AS letters,
           count(*) FILTER (WHERE length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) = 0) AS noise
    FROM documents GROUP BY lang""",
)
def char_class_counts(spark, sf):
    heard = tx.letters_and_digits(F.col("text"))
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("chars"), F.sum(tx.count_of(F.col("text"), tx.LATIN)).alias("latin"),
        F.sum(F.length(heard)).alias("letters"), F.count_if(F.length(heard) == 0).alias("noise"),
    )


@P.add("display_units", f"SELECT cue_id, {_units('coalesce(tgt_text, chr(32))')} AS units FROM cues", over_cues=True)
def display_units(spark, sf):
    return cues(spark, sf).select("cue_id", tx.display_units(F.col("tgt_text")).alias("units"))


@P.add(
    "text_cleaning",
    rf"""
    SELECT cue_id, {_clean("src_text")} AS cleaned,
           trim(regexp_replace(lower(coalesce(src_text, '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
           CASE WHEN length({_clean("src_text")}) > 20 THEN substr({_clean("src_text")}, 1, 19) || '…' ELSE {_clean("src_text")} END AS preview,
           len(regexp_extract_all(coalesce(src_text, ''), '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) AS n_tokens,
           {_clean(r"regexp_replace(regexp_replace(coalesce('<i>' || src_text || '</i>', ''), '<[^>]*>|\{[^}]*\}', '', 'g'), '\\[Nnh]', ' ', 'g')")} AS plain
    FROM cues""",
    over_cues=True,
)
def text_cleaning(spark, sf):
    t = F.col("src_text")
    return cues(spark, sf).select(
        "cue_id", tx.clean(t).alias("cleaned"), tx.slug(t).alias("slug"), tx.preview(t, 20).alias("preview"),
        F.size(tx.tokens(t)).alias("n_tokens"), tx.markup_stripped(F.concat(F.lit("<i>"), t, F.lit("</i>"))).alias("plain"),
    )


@P.add(
    "reject_reasons",
    """
    WITH r AS (SELECT CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'missing_text' WHEN length(text) < 200 THEN 'too_short'
                        WHEN length(text) > 10000 THEN 'too_long' END AS reason, length(text) AS n FROM documents)
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_docs, sum(n)::BIGINT AS chars FROM r GROUP BY 1""",
)
def reject_reasons(spark, sf):
    n = F.length("text")
    reason = flags.reject_reason({"missing_text": F.btrim(tx.text(F.col("text"))) == "", "too_short": n < 200, "too_long": n > 10000})
    rows = table(spark, sf, "documents").select(F.coalesce(reason, F.lit("kept")).alias("reason"), n.alias("n"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("chars"))


@P.add("token_budget", "SELECT cue_id, greatest(64, ceil((end_ms - start_ms) * 10 / 1000.0)::BIGINT + 16) AS budget FROM cues", over_cues=True)
def token_budget(spark, sf):
    return cues(spark, sf).select("cue_id", tx.token_budget(F.col("end_ms") - F.col("start_ms")).alias("budget"))


@P.add(
    "glossary_parse",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '[,，\n]')) AS line FROM documents),
    p AS (SELECT doc_id, trim(split_part(line, '-', 1), ' ') AS source, trim(regexp_replace(line, '^[^-]*-', ''), ' ') AS target
          FROM l WHERE line NOT LIKE '%->%' AND line LIKE '%-%')
    SELECT * FROM p WHERE source <> '' AND target <> ''""",
)
def glossary_parse(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "[,，\n]")).alias("line"))
    return lines.select("doc_id", tx.glossary_pair(F.col("line")).alias("p")).where("p is not null").select("doc_id", "p.*")


@P.add(
    "dedup_text_hash",
    "SELECT sha1(coalesce(text, '')) AS key, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1",
)
def dedup_text_hash(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", caching.text_key(F.col("text")).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@P.add(
    "last_writer_wins",
    "SELECT sha1(coalesce(text, '')) AS key, arg_max(source, doc_id) AS value, max(doc_id) AS doc_id FROM documents GROUP BY 1",
)
def last_writer_wins(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", caching.text_key(F.col("text")).alias("key"), F.col("source").alias("value"))
    return caching.last_writer(rows, "key", "doc_id")


@P.add(
    "two_level_cache",
    """
    WITH k AS (SELECT doc_id, sha1(coalesce(text, '')) AS row_key, source || '::' || (doc_id // 10) AS batch_key FROM documents),
    r AS (SELECT row_key, max(doc_id) AS doc_id FROM k WHERE doc_id % 2 = 0 GROUP BY 1),
    b AS (SELECT DISTINCT batch_key FROM k WHERE doc_id % 7 = 0)
    SELECT k.doc_id, CASE WHEN b.batch_key IS NOT NULL THEN 'batch' WHEN r.row_key IS NOT NULL THEN 'row' ELSE 'pending' END AS level,
           CASE WHEN b.batch_key IS NOT NULL THEN 'B' ELSE r.doc_id::VARCHAR END AS value
    FROM k LEFT JOIN b USING (batch_key) LEFT JOIN r USING (row_key)""",
)
def two_level_cache(spark, sf):
    batch = F.concat("source", F.lit("::"), F.expr("doc_id div 10").cast("string"))
    k = table(spark, sf, "documents").select("doc_id", caching.text_key(F.col("text")).alias("row_key"), batch.alias("batch_key"))
    r = k.where("doc_id % 2 = 0").groupBy(F.col("row_key").alias("key")).agg(F.max("doc_id").cast("string").alias("value"))
    b = k.where("doc_id % 7 = 0").select(F.col("batch_key").alias("key"), F.lit("B").alias("value")).distinct()
    return caching.probe(k, b, r).select("doc_id", "level", "value")


@P.add(
    "pending_rows",
    "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)",
)
def pending_rows(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return caching.pending(table(spark, sf, "benchmark").select("item_id"), done, "item_id")


@P.add("row_keys", "SELECT doc_id, substr(sha256(doc_id || chr(0) || source || chr(0) || lang), 1, 24) AS key FROM documents")
def row_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", caching.row_key(F.col("doc_id"), F.col("source"), F.col("lang")).alias("key"))


@P.add(
    "spans_digest",
    """
    SELECT media_id, substr(sha256(string_agg(start_ms || '-' || end_ms, ';' ORDER BY start_ms, end_ms, cue_id)), 1, 16) AS digest,
           count(*) AS n FROM cues GROUP BY media_id""",
    over_cues=True,
)
def spans_digest(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "cue_id")))
    line = F.array_join(F.transform(parts, lambda x: F.concat(x["start_ms"], F.lit("-"), x["end_ms"])), ";")
    return cues(spark, sf).groupBy("media_id").agg(F.substring(F.sha2(line, 256), 1, 16).alias("digest"), F.count(F.lit(1)).alias("n"))


@P.add(
    "stratified_sample",
    """
    SELECT doc_id, source, rank FROM (
      SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s1:' || doc_id), doc_id) AS rank FROM documents)
    WHERE rank <= 5""",
)
def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "documents").select("doc_id", "source"), "source", 5, "s1", "doc_id")


@P.add(
    "disjoint_samples",
    """
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s2:' || doc_id), doc_id) AS rank FROM documents)
    SELECT *, CASE WHEN rank <= 3 THEN 'pilot' ELSE 'main' END AS sample FROM r WHERE rank <= 10""",
)
def disjoint_samples(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return sampling.disjoint_samples(rows, "source", {"pilot": 3, "main": 7}, "s2", "doc_id")


@P.add(
    "group_split",
    """
    WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('s3:' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 sum(n) OVER () AS total FROM s)
    SELECT source, n, CASE WHEN before * 1000 < total * 200 THEN 'val' ELSE 'train' END AS split FROM b""",
)
def group_split(spark, sf):
    return sampling.group_split(table(spark, sf, "documents"), "source", 200, "s3")


@P.add(
    "positional_split",
    """
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents WHERE length(text) >= 200)
    SELECT *, CASE WHEN pos <= 4 THEN 'val' WHEN pos <= 8 THEN 'test' ELSE 'train' END AS split FROM r WHERE pos <= 28""",
)
def positional_split(spark, sf):
    rows = table(spark, sf, "documents").where(F.length("text") >= 200).select("doc_id", "source")
    return sampling.positional_split(rows, "source", "doc_id", 4, 4, 20)


@P.add(
    "batch_plan",
    """
    , b AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY cue_id) - 1) // 8 AS batch FROM cues),
    c AS (SELECT media_id, batch, sum(length(coalesce(src_text, '')))::BIGINT AS cost FROM b GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY cost DESC, batch) AS submit FROM c""",
    over_cues=True,
)
def batch_plan(spark, sf):
    return sampling.batch_costs(sampling.fixed_batches(cues(spark, sf), "media_id", "cue_id", 8), "media_id", "src_text")


@P.add(
    "length_buckets",
    "SELECT length(text) // 500 AS bucket, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents GROUP BY 1",
)
def length_buckets(spark, sf):
    rows = sampling.length_buckets(table(spark, sf, "documents").select(F.length("text").alias("n_text")), F.col("n_text"), 500)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("n_text").alias("shortest"), F.max("n_text").alias("longest"))


VOCAB = r"""
    WITH c AS (SELECT unnest(string_split(text, '')) AS char FROM documents),
    n AS (SELECT char, count(*) AS n FROM c WHERE regexp_full_match(char, '\S') GROUP BY char),
    v AS (SELECT row_number() OVER (ORDER BY n DESC, char) + 1 AS id, char, n FROM n WHERE n >= 3 ORDER BY n DESC, char LIMIT 50)"""


@P.add("vocab_topk", VOCAB + " SELECT * FROM v")
def vocab_topk(spark, sf):
    return sampling.vocabulary(table(spark, sf, "documents"), "text", 3, 50)


@P.add("vocab_coverage", VOCAB + " SELECT sum(n.n)::BIGINT AS total, sum(CASE WHEN v.id IS NOT NULL THEN n.n ELSE 0 END)::BIGINT AS covered FROM n LEFT JOIN v USING (char)")
def vocab_coverage(spark, sf):
    docs = table(spark, sf, "documents")
    return sampling.coverage(docs, "text", sampling.vocabulary(docs, "text", 3, 50))


@P.add(
    "vocab_encode",
    f"""
    WITH k AS ({VOCAB} SELECT map_from_entries(list((char, id::INTEGER))) AS ids FROM v)
    SELECT doc_id, list_transform(string_split(text, ''), lambda c: coalesce(map_extract_value(k.ids, c), 1)) AS ids
    FROM documents, k WHERE text <> ''""",
)
def vocab_encode(spark, sf):
    """Whole documents with the vocabulary of ``vocab_topk``; 1 for other characters."""
    docs = table(spark, sf, "documents")
    vocab = sampling.vocabulary(docs, "text", 3, 50).collect()  # at most 50 rows
    ids = sampling.encode(F.col("text"), {r["char"]: r["id"] for r in vocab})
    return docs.where("text <> ''").select("doc_id", ids.cast("array<int>").alias("ids"))


@P.add(
    "vocab_encode_whole",
    f"""
    , k AS ({VOCAB} SELECT map_from_entries(list((char, id::INTEGER))) AS ids FROM v)
    SELECT cue_id, list_transform(string_split(src_text, ''), lambda c: coalesce(map_extract_value(k.ids, c), 1)) AS ids
    FROM cues, k WHERE src_text <> ''""",
    over_cues=True,
)
def vocab_encode_whole(spark, sf):
    vocab = sampling.vocabulary(table(spark, sf, "documents"), "text", 3, 50)
    ids = sampling.encode(F.col("src_text"), {r["char"]: r["id"] for r in vocab.collect()})  # at most 50 rows
    return cues(spark, sf).where("src_text <> ''").select("cue_id", ids.cast("array<int>").alias("ids"))


ZZ = "(1.96::DOUBLE * 1.96::DOUBLE)"
WILSON = f"""((hits / n + {ZZ} / (2 * n::DOUBLE) {{sign}} 1.96::DOUBLE * sqrt(hits / n * (1 - hits / n) / n + {ZZ} / (4 * n::DOUBLE * n))) / (1 + {ZZ} / n::DOUBLE))"""


@P.add(
    "wilson_by_stratum",
    f"""
    WITH r AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS hits FROM ({LABELLED}) GROUP BY source)
    SELECT source, n, hits, hits / n AS rate, {WILSON.format(sign="-")} AS low, {WILSON.format(sign="+")} AS high FROM r""",
)
def wilson_by_stratum(spark, sf):
    return stats.rates(labelled(spark, sf), "source", F.col("toxic") == 1)


CONFUSION = f"""
    WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fp,
                      count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn
               FROM ({LABELLED}) GROUP BY lang)"""


@P.add("confusion_by_label", CONFUSION + " SELECT * FROM c")
def confusion_by_label(spark, sf):
    return stats.confusion(labelled(spark, sf), "lang", F.col("quality") == 1, F.col("toxic") == 0)


@P.add(
    "label_agreement",
    CONFUSION + " SELECT *, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, (tp + tn) / (tp + fp + fn + tn) AS agreement FROM c",
)
def label_agreement(spark, sf):
    return stats.agreement(stats.confusion(labelled(spark, sf), "lang", F.col("quality") == 1, F.col("toxic") == 0))


@P.add(
    "rates_against_floor",
    f"""
    WITH r AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS hits FROM ({LABELLED}) GROUP BY lang),
    f AS (SELECT hits AS fh, n AS fn FROM r WHERE lang = 'en'),
    d AS (SELECT lang, n, hits, hits / n - fh / fn AS difference,
                 1.96 * sqrt(hits / n * (1 - hits / n) / n + fh / fn * (1 - fh / fn) / fn) AS spread FROM r, f WHERE lang <> 'en')
    SELECT lang, n, hits, difference, difference - spread AS low, difference + spread AS high,
           difference - spread > 0 OR difference + spread < 0 AS separated FROM d""",
)
def rates_against_floor(spark, sf):
    return stats.against_floor(stats.rates(labelled(spark, sf), "lang", F.col("quality") == 1), "lang", "en")


@P.add(
    "weighted_mean",
    f"SELECT lang, sum(quality * greatest(n_chars, 1))::BIGINT / sum(greatest(n_chars, 1))::BIGINT AS mean FROM ({LABELLED}) GROUP BY lang",
)
def weighted_mean(spark, sf):
    return labelled(spark, sf).groupBy("lang").agg(stats.weighted_mean(F.col("quality"), F.col("n_chars")).alias("mean"))


@P.add(
    "nearest_rank_quantile",
    """
    WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, n_chars AS p95 FROM r WHERE rn = least(n, floor(n * 0.95::DOUBLE)::BIGINT + 1)""",
)
def nearest_rank_quantile(spark, sf):
    return stats.nearest_rank(table(spark, sf, "documents"), "lang", "n_chars", 0.95).withColumnRenamed("n_chars", "p95")


@P.add(
    "corpus_summary",
    """
    SELECT source, count(*) AS clips, count(DISTINCT lang) AS langs, sum(length(text))::BIGINT AS chars, avg(length(text)) AS mean_chars,
           quantile_cont(length(text), 0.5) AS median_chars FROM documents GROUP BY source""",
)
def corpus_summary(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("clips"), F.countDistinct("lang").alias("langs"), F.sum(n).alias("chars"), F.avg(n).alias("mean_chars"),
        F.percentile(n, 0.5).alias("median_chars"),
    )
