"""Queries over whole texts: normal forms, keys, tolerant parsing, issue classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.functions import normal as nf
from cuelake.functions import text as tx
from cuelake.operators import context, quality
from cuelake.plans.media import GLOSSARY, W, _clean, _units
from cuelake.plans.registry import Plans, banned_sql
from cuelake.sources import reports
from cuelake.sources.tables import cues, table

P = Plans()
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _stripped(x: str) -> str:
    return f"trim(coalesce({x}, ''), {WS})"


def _one_line(x: str) -> str:
    return _stripped(f"regexp_replace(translate(coalesce({x}, ''), chr(13) || chr(10), '  '), '[ \\t]+', ' ', 'g')")


def _joined(x: str) -> str:
    even = f"regexp_replace(regexp_replace(coalesce({x}, ''), '[ \\t]+', ' ', 'g'), '\\r\\n?', chr(10), 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({even}, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> ''), chr(10))"


def _replaced(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return x


@P.add(
    "source_normal_form",
    f"SELECT doc_id, sha1({_joined('text')}) AS text_sha1, length({_joined('text')}) AS n_chars, sha1({_one_line('text')}) AS line_sha1 FROM documents",
)
def source_normal_form(spark, sf):
    lines, line = nf.joined_lines(F.col("text")), nf.one_line(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.sha1(lines).alias("text_sha1"), F.length(lines).cast("long").alias("n_chars"), F.sha1(line).alias("line_sha1")
    )


ANSWER = "CASE conv_id % 4 WHEN 0 THEN 'Translation> ' WHEN 1 THEN 'original>' ELSE '' END || CASE turn % 2 WHEN 0 THEN '\"' ELSE '' END || text || CASE turn % 3 WHEN 0 THEN '”' ELSE '' END"


@P.add(
    "answer_normal_form",
    rf"""
    WITH a AS (SELECT conv_id, turn, {ANSWER} AS answer FROM conversations),
    b AS (SELECT *, regexp_replace(regexp_replace({_stripped("answer")}, '(?i)^(?:Translation>\s*)?(?:Original>\s*)?', ''),
                                   '^[''"“”‘’]+|[''"“”‘’]+$', '', 'g') AS bare FROM a)
    SELECT conv_id, turn, nullif(replace({_joined("bare")}, chr(10), '\n'), '') AS answer FROM b""",
)
def answer_normal_form(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(ANSWER).alias("answer"))
    return rows.select("conv_id", "turn", nf.answer_text(F.col("answer")).alias("answer"))


THOUGHTS = "CASE turn % 3 WHEN 0 THEN '<think>' || text || '</THINK> ' || text WHEN 1 THEN text || '</think>' || text || ' ' ELSE text END"


@P.add(
    "reasoning_stripped",
    rf"""
    WITH a AS (SELECT conv_id, turn, {THOUGHTS} AS answer FROM conversations)
    SELECT conv_id, turn, trim(regexp_replace(regexp_replace(answer, '(?is)<think>.*?</think>', '', 'g'), '(?is)^.*</think>', ''), {WS}) AS answer FROM a""",
)
def reasoning_stripped(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(THOUGHTS).alias("answer"))
    return rows.select("conv_id", "turn", nf.without_thoughts(F.col("answer")).alias("answer"))


def _display(x: str) -> str:
    """The display rules for an engine without look-around: commas between digits are hidden first."""
    t = f"translate(regexp_replace({x}, '(?i)</?\\s*(?:i|b|u|em|strong|font)(?:\\s[^>]*)?>|\\{{\\\\[^}}]*\\}}', '', 'g'), '０１２３４５６７８９', '0123456789')"
    t = _replaced(t, (r"(?:[…⋯‥]|\.{3,}|。{2,}|・{3,}|·{3,})+", "…"))
    t = _replaced(f"translate({t}, '?!', '？！')", ("([？！])[？！]+", r"\1"))
    t = _replaced(t, ("([0-9]),([0-9])", "\\1\x01\\2"), ("([0-9]),([0-9])", "\\1\x01\\2"), ("[，,。]", " "), ("\x01", ","), ('"([^"\\n]*)"', r"“\1”"))
    neat = "trim(regexp_replace(trim(regexp_replace(x, '[ \\t\\x{3000}]+', ' ', 'g'), ' '), '、+$', ''), ' ')"
    lines = f"string_split(replace({t}, '\\n', chr(10)), chr(10))"
    return f"array_to_string(list_filter(list_transform({lines}, lambda x: {neat}), lambda x: x <> ''), chr(10))"


@P.add("display_texts", f"SELECT doc_id, sha1({_display('text')}) AS text_sha1, length({_display('text')}) AS n_chars FROM documents")
def display_texts(spark, sf):
    shown = nf.display_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha1(shown).alias("text_sha1"), F.length(shown).cast("long").alias("n_chars"))


@P.add(
    "evaluation_keys",
    rf"""
    SELECT doc_id, sha1(regexp_replace(text, '{nf.EVALUATED}', '', 'g')) AS evaluated_sha1,
           sha1(regexp_replace(regexp_replace(regexp_replace(lower(text), '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '{nf.MATCHED}', '', 'g')) AS match_sha1
    FROM documents""",
)
def evaluation_keys(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.sha1(nf.evaluated(F.col("text"))).alias("evaluated_sha1"), F.sha1(nf.match_key(F.col("text"))).alias("match_sha1")
    )


@P.add(
    "low_value_lines",
    rf"""
    WITH l AS (SELECT doc_id, {_one_line("x.line")} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) x)
    SELECT doc_id, count(*) AS n_lines,
           count(*) FILTER (WHERE regexp_replace(line, '{tx.PUNCTUATION}', '', 'g') = '' OR regexp_matches(line, '{nf.LOW_VALUE}')) AS low_value
    FROM l GROUP BY doc_id""",
)
def low_value_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(nf.low_value(F.col("line"))).alias("low_value"))


@P.add(
    "noise_segments",
    f"""
    , p AS (SELECT *, row_number() OVER ({W}) - 1 AS position FROM cues)
    SELECT media_id, position, cue_id, start_ms, end_ms, tgt_text FROM p WHERE length(regexp_replace(coalesce(tgt_text, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) = 0
    QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY position) <= 50""",
    over_cues=True,
)
def noise_segments(spark, sf):
    """Each medium's first 50 cues without a letter or digit, with their positions among all its cues."""
    from cuelake.operators.windows import by_media

    placed = cues(spark, sf).withColumn("position", F.row_number().over(by_media()).cast("long") - 1)
    first = F.row_number().over(Window.partitionBy("media_id").orderBy("position"))
    rows = placed.where(tx.is_noise(F.col("tgt_text"))).withColumn("rn", first).where("rn <= 50")
    return rows.select("media_id", "position", "cue_id", "start_ms", "end_ms", "tgt_text")


@P.add(
    "safe_numbers",
    rf"""
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents),
    n AS (SELECT doc_id, CASE WHEN regexp_matches(word, '{nf.NUMBER}') THEN try_cast(trim(word, {WS}) AS DOUBLE) END AS x FROM w)
    SELECT doc_id, count(x) AS n_numbers, max(x) AS largest, min(x) AS smallest FROM n WHERE x IS NULL OR isfinite(x) GROUP BY doc_id""",
)
def safe_numbers(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    n = words.select("doc_id", nf.safe_number(F.col("word")).alias("x"))
    return n.groupBy("doc_id").agg(F.count("x").alias("n_numbers"), F.max("x").alias("largest"), F.min("x").alias("smallest"))


@P.add(
    "first_texts",
    f"""
    SELECT doc_id, coalesce(nullif({_clean("CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END")}, ''), nullif({_clean("CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END")}, ''),
                            nullif({_clean("text")}, ''), '') AS text FROM documents""",
)
def first_texts(spark, sf):
    found = nf.first_text(
        F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source")), F.when(F.col("doc_id") % 2 != 0, F.col("lang")), F.col("text")
    )
    return table(spark, sf, "documents").select("doc_id", found.alias("text"))


USAGE = "'{\"usage\": {\"' || CASE event_id % 3 WHEN 0 THEN 'input_tokens' WHEN 1 THEN 'prompt_tokens' ELSE 'other' END || '\": ' || CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '\"12\"' ELSE concat('', event_id) END || '}}'"


@P.add(
    "usage_totals",
    f"""
    WITH u AS (SELECT user_id, {USAGE} AS usage FROM events),
    v AS (SELECT user_id, coalesce(try_cast(usage->>'$.usage.input_tokens' AS DOUBLE)::BIGINT, try_cast(usage->>'$.usage.prompt_tokens' AS DOUBLE)::BIGINT) AS n FROM u)
    SELECT user_id, sum(n)::BIGINT AS input_tokens, count(*) AS requests, count(n) AS counted FROM v GROUP BY user_id""",
)
def usage_totals(spark, sf):
    """Sums over alias fields of a JSON text; null where no request names one."""
    rows = table(spark, sf, "events").select("user_id", F.expr(USAGE).alias("usage"))
    n = nf.first_integer(F.col("usage"), "$.usage.input_tokens", "$.usage.prompt_tokens")
    rows = rows.select("user_id", n.alias("n"))
    return rows.groupBy("user_id").agg(F.sum("n").alias("input_tokens"), F.count(F.lit(1)).alias("requests"), F.count("n").alias("counted"))


MAPPING = "source || ' = ' || (doc_id % 5) || ', x=' || n_chars || '.7,bad,=' || doc_id || ',y=no, x = 3 ,' || lang || '=0'"


@P.add(
    "named_counts",
    rf"""
    WITH s AS (SELECT doc_id, unnest(list_zip(p, range(len(p))), recursive := false) AS z FROM (SELECT doc_id, string_split({MAPPING}, ',') AS p FROM documents)),
    p AS (SELECT doc_id, trim(regexp_replace(z[1], '=[^=]*$', ''), {WS}) AS name, z[2] AS pos,
                 greatest(1, floor(trim(regexp_extract(z[1], '=([^=]*)$', 1), {WS})::DOUBLE))::INTEGER AS n
          FROM s WHERE regexp_matches(z[1], '^.*=\s*[0-9]+(\.[0-9]*)?\s*$'))
    SELECT doc_id, name, arg_max(n, pos) AS n FROM p GROUP BY doc_id, name""",
)
def named_counts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", nf.named_counts(F.expr(MAPPING)).alias("m"))
    return rows.select("doc_id", F.explode("m").alias("name", "n"))


SIGNATURE = "substr(sha1('v3' || chr(10) || {lang} || chr(10) || coalesce(source, '') || chr(10) || {model}{effort}), 1, 12)"
EFFORT = "|| CASE WHEN coalesce(lang, '') <> 'en' THEN chr(10) || 'reasoning=high' ELSE '' END"


@P.add(
    "translation_keys",
    f"""
    WITH k AS (SELECT doc_id, text, 'batch::' || {SIGNATURE.format(lang="lang", model="'Big:7b'", effort=EFFORT)} || '::' || doc_id || '::' || substr(sha1({_joined("text")}), 1, 16) AS batch_key,
                      {SIGNATURE.format(lang="lang", model="'big'", effort=EFFORT)} AS sig FROM documents)
    SELECT doc_id, batch_key, 'tm::' || sig || '::' || substr(sha1({_joined("text")}), 1, 16) AS memory_key FROM k""",
)
def translation_keys(spark, sf):
    """Keys of the batch cache (model and place count) and of the line memory (the model's family counts)."""
    effort = F.when(tx.text(F.col("lang")) != "en", " High ")
    text, model = F.col("text"), F.lit("Big:7b")
    sign = lambda m: nf.prompt_signature(F.lit("v3"), F.col("lang"), F.col("source"), m, effort=effort)
    batch = F.concat_ws("::", F.lit("batch"), sign(model), F.col("doc_id"), F.substring(F.sha1(nf.joined_lines(text)), 1, 16))
    return table(spark, sf, "documents").select(
        "doc_id", batch.alias("batch_key"), nf.memory_key(text, sign(nf.model_family(model))).alias("memory_key")
    )


@P.add(
    "usable_terms",
    rf"""
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents),
    t AS (SELECT trim(word, {WS}) AS term, count(*) AS n, min(doc_id) AS first_doc FROM w
          WHERE length(trim(word, {WS})) BETWEEN 1 AND 8 AND NOT regexp_matches(trim(word, {WS}), '{nf.TERM_SIGNS}') GROUP BY 1)
    SELECT * FROM t WHERE term NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL) AND n >= 2""",
)
def usable_terms(spark, sf):
    """Short terms without signs that occur twice and are not among the known ones (an anti join)."""
    docs = table(spark, sf, "documents")
    words = docs.select("doc_id", F.explode(F.split("text", " ")).alias("word")).where(nf.term_is_usable(F.col("word")))
    terms = words.groupBy(nf.stripped(F.col("word")).alias("term")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return terms.where("n >= 2").join(docs.select(F.col("lang").alias("term")).distinct(), "term", "left_anti")


MODE = "CASE cue_id % 4 WHEN 0 THEN 'ctc_forced_alignment' WHEN 1 THEN ' boundary_proportional' WHEN 2 THEN 'other' ELSE NULL END"


@P.add(
    "issue_subtypes",
    rf"""
    , i AS (SELECT media_id, CASE WHEN length(regexp_replace(coalesce(src_text, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) = 0 AND cue_id % 2 = 0 THEN 'nonlexical_text'
              WHEN {_stripped("tgt_text")} = '' AND end_ms - start_ms >= 1000 THEN 'asr_empty_text'
              WHEN {_stripped("tgt_text")} <> '' AND cue_id % 7 = 0 THEN 'text_without_output_segment'
              WHEN NOT trim(coalesce({MODE}, ''), ' ') IN ('', 'boundary_proportional', 'nonlexical', 'ctc_forced_alignment') THEN 'unknown_alignment_mode'
              WHEN cue_id % 5 = 0 THEN 'subtitle_timing_error' ELSE 'none' END AS subtype FROM cues)
    SELECT media_id, subtype, count(*) AS n FROM i GROUP BY ALL""",
    over_cues=True,
)
def issue_subtypes(spark, sf):
    found = nf.issue_subtype(
        F.expr(MODE), tx.is_noise(F.col("src_text")) & (F.col("cue_id") % 2 == 0), F.col("tgt_text"), (F.col("end_ms") - F.col("start_ms")) / 1000,
        F.col("cue_id") % 7, F.when(F.col("cue_id") % 5 == 0, "late"),
    )
    return cues(spark, sf).groupBy("media_id", found.alias("subtype")).agg(F.count(F.lit(1)).alias("n"))


@P.add(
    "decode_limits",
    """
    , b AS (SELECT cue_id, end_ms - start_ms AS d, greatest(64, ceil((end_ms - start_ms) * 10 / 1000.0)::BIGINT + 16) AS budget FROM cues),
    l AS (SELECT *, greatest(3, ceil(budget * 0.5))::BIGINT AS least_tokens FROM b)
    SELECT cue_id, CASE WHEN d <= 3000 THEN 250 WHEN d <= 7000 THEN 400 ELSE 600 END AS snap_ms, greatest(1, least_tokens // 3)::BIGINT AS longest_ngram, least_tokens FROM l""",
    over_cues=True,
)
def decode_limits(spark, sf):
    d = F.col("end_ms") - F.col("start_ms")
    ngram, least = nf.loop_guard(tx.token_budget(d))
    return cues(spark, sf).select("cue_id", nf.snap_window_ms(d).alias("snap_ms"), ngram.alias("longest_ngram"), least.alias("least_tokens"))


@P.add(
    "response_budgets",
    """
    WITH b AS (SELECT conv_id, sum(length(coalesce(text, '')))::BIGINT AS chars, count(*) AS items, max(length(coalesce(text, ''))) AS longest FROM conversations GROUP BY conv_id)
    SELECT conv_id, greatest(96, floor(chars * 1.5 + 28 * items + 32))::BIGINT AS budget, greatest(32, floor(longest * 1.5))::BIGINT AS most_chars FROM b""",
)
def response_budgets(spark, sf):
    n = F.length(tx.text(F.col("text")))
    b = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(n).alias("chars"), F.count(F.lit(1)).alias("items"), F.max(n).alias("longest"))
    return b.select(
        "conv_id", nf.response_budget(F.col("chars"), F.col("items")).alias("budget"),
        F.greatest(F.lit(32).cast("long"), F.floor(F.col("longest") * 1.5)).alias("most_chars"),
    )


@P.add(
    "batch_payloads",
    """
    SELECT conv_id, '[' || string_agg('{"id":' || turn || CASE WHEN role IS NULL THEN '' ELSE ',"role":"' || role || '"' END || ',"chars":' || length(text) || '}', ',' ORDER BY turn, text) || ']' AS payload
    FROM conversations GROUP BY conv_id""",
)
def batch_payloads(spark, sf):
    """A conversation's turns as one JSON array; missing fields are left out.  A conversation is one request: of bounded size."""
    item = F.struct(F.col("turn").alias("id"), "role", F.length("text").alias("chars"))
    rows = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "text", item.alias("item")).alias("r"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return listed.select("conv_id", F.to_json(F.col("r.item")).alias("payload"))


@P.add(
    "context_lines",
    f"""
    , l AS (SELECT media_id, row_number() OVER ({W}) - 1 AS rn, {_one_line("src_text")} AS line, (start_ms + 5) // 10 AS a, (end_ms + 5) // 10 AS b FROM cues)
    SELECT media_id, left(string_agg(printf('%04d [%d.%02d->%d.%02d] ', rn, a // 100, a % 100, b // 100, b % 100) || line, chr(10) ORDER BY rn), 2000) AS context
    FROM l WHERE line <> '' GROUP BY media_id""",
    over_cues=True,
)
def context_lines(spark, sf):
    return context.context_lines(cues(spark, sf), "src_text", 2000)


@P.add(
    "label_aliases",
    """
    SELECT label, CASE label % 4 WHEN 0 THEN 'pause' WHEN 1 THEN 'speech' WHEN 2 THEN 'unsure' END AS normal, count(*) AS n FROM embeddings GROUP BY label""",
)
def label_aliases(spark, sf):
    """Labels through an alias map; null for what the vocabulary does not hold."""
    known = F.create_map(*(F.lit(x) for x in (0, "pause", 1, "speech", 2, "unsure")))
    rows = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("label", F.try_element_at(known, (F.col("label") % 4).cast("int")).alias("normal"), "n")


@P.add(
    "quality_report_full",
    f"""
    , g AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in GLOSSARY)}) t(a, b)),
    k AS (SELECT media_id, count(*) AS checks, count(*) FILTER (WHERE contains(coalesce(tgt_text, ''), b)) AS hits FROM cues JOIN g ON contains(coalesce(src_text, ''), a) GROUP BY media_id),
    r AS (SELECT *, trim(coalesce(tgt_text, ''), ' ') AS t, lag(trim(coalesce(tgt_text, ''), ' ')) OVER (PARTITION BY media_id ORDER BY cue_id) AS b FROM cues),
    a AS (SELECT media_id, count(*) AS n_cues, count(*) FILTER (WHERE t = '') / count(*) AS empty_ratio, count(*) FILTER (WHERE t <> '' AND t = b) / count(*) AS repetition_ratio,
                 count(*) FILTER (WHERE t = '' OR regexp_matches(trim(coalesce(src_text, ''), ' '), '{quality.KANA_ONLY}')) / count(*) AS kana_only_ratio,
                 count(*) FILTER (WHERE end_ms - start_ms < 800) / count(*) AS short_ratio, count(*) * 60000.0::DOUBLE / greatest(max(end_ms) - min(start_ms), 60) AS per_min_count
          FROM r GROUP BY media_id)
    SELECT a.*, hits / nullif(checks, 0) AS glossary_hit_rate FROM a LEFT JOIN k USING (media_id)""",
    over_cues=True,
)
def quality_report_full(spark, sf):
    return quality.full_report(cues(spark, sf), GLOSSARY)


@P.add(
    "overlap_examples",
    f"""
    , o AS (SELECT media_id, cue_id, lag(start_ms) OVER ({W}) AS previous_start, lag(end_ms) OVER ({W}) AS previous_end, start_ms, end_ms, lag(end_ms) OVER ({W}) - start_ms AS overlap_ms FROM cues),
    p AS (SELECT *, row_number() OVER ({W}) AS place FROM o WHERE overlap_ms > 0)
    SELECT * FROM p WHERE place <= 20""",
    over_cues=True,
)
def overlap_examples(spark, sf):
    return quality.overlap_examples(cues(spark, sf))


@P.add(
    "rate_extremes",
    f"""
    , s AS (SELECT media_id, greatest(1, end_ms - start_ms) AS d, coalesce(tgt_text, '') AS raw, {_display("coalesce(tgt_text, '')")} AS shown, lead(start_ms) OVER ({W}) - end_ms AS gap FROM cues),
    u AS (SELECT *, replace(replace(shown, ' ', ''), chr(10), '') AS flat FROM s)
    SELECT media_id, max({_units("flat")} * 1000.0::DOUBLE / d) AS max_rate, sum({banned_sql("raw")})::BIGINT AS raw_banned, sum({banned_sql("shown")})::BIGINT AS banned,
           count(*) FILTER (WHERE gap BETWEEN 0 AND 82) AS near_count FROM u GROUP BY media_id""",
    over_cues=True,
)
def rate_extremes(spark, sf):
    return quality.rate_extremes(cues(spark, sf))


PAIRS_SQL = rf"""
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS a, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
    p AS (SELECT doc_id, pos, a AS source, lead(a) OVER (PARTITION BY doc_id ORDER BY pos) AS target FROM w),
    u AS (SELECT doc_id, pos, trim(source, {WS}) AS source, trim(target, {WS}) AS target FROM p
          WHERE length(trim(source, {WS})) BETWEEN 1 AND 8 AND length(trim(target, {WS})) BETWEEN 1 AND 8
            AND NOT regexp_matches(trim(source, {WS}), '{nf.TERM_SIGNS}') AND NOT regexp_matches(trim(target, {WS}), '{nf.TERM_SIGNS}')
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, source, target) <= 15)"""


def _word_pairs(spark, sf):
    """Every word of a document with the word after it."""
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "source"))
    after = F.lead("source").over(Window.partitionBy("doc_id").orderBy("pos"))
    return words.select("doc_id", F.col("pos").cast("long").alias("pos"), "source", after.alias("target"))


@P.add("glossary_terms", PAIRS_SQL + " SELECT * FROM u")
def glossary_terms(spark, sf):
    return context.usable_pairs(_word_pairs(spark, sf), "doc_id", "pos")


@P.add(
    "formatted_glossary",
    PAIRS_SQL
    + """, k AS (SELECT DISTINCT lower(r_name) AS source FROM region UNION SELECT DISTINCT lang FROM documents),
    f AS (SELECT * FROM u WHERE source NOT IN (SELECT source FROM k WHERE source IS NOT NULL)
          QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY pos, target) = 1)
    SELECT doc_id, string_agg(source || '-' || target, chr(10) ORDER BY pos, source) AS terms FROM f GROUP BY doc_id""",
)
def formatted_glossary(spark, sf):
    """A document's first usable word pairs as lines, without words that are a language or a region."""
    known = table(spark, sf, "region").select(F.lower("r_name").alias("source")).unionByName(table(spark, sf, "documents").select(F.col("lang").alias("source")))
    return context.formatted_terms(context.usable_pairs(_word_pairs(spark, sf), "doc_id", "pos"), "doc_id", "pos", known)


@P.add(
    "report_lines",
    """
    , r AS (SELECT media_id, count(*) AS cues, count(*) FILTER (WHERE coalesce(tgt_text, '') = '') / count(*) AS empty_ratio, max(end_ms - start_ms) AS longest_ms,
                   count(*) FILTER (WHERE end_ms - start_ms < 834) AS short_count, NULL::BIGINT AS missing FROM cues GROUP BY 1),
    w AS (SELECT *, list_concat(CASE WHEN empty_ratio > 0.04 THEN ['many empty lines'] ELSE [] END, CASE WHEN short_count > 5 THEN ['short cues: ' || short_count] ELSE [] END) AS warnings FROM r),
    l AS (SELECT media_id, list_concat(['# Quality Report: ' || media_id, '', '## Summary', '', '| Metric | Value |', '| --- | ---: |', '| `cues` | ' || cues || ' |',
            '| `empty_ratio` | ' || regexp_replace(printf('%.4f', round(empty_ratio, 4)), '\\.?0+$', '') || ' |', '| `longest_ms` | ' || longest_ms || ' |', '| `short_count` | ' || short_count || ' |',
            '| `missing` | N/A |', '', '## Warnings', ''], CASE WHEN len(warnings) > 0 THEN list_transform(warnings, lambda x: '- ' || x) ELSE ['- None'] END, ['']) AS ls FROM w)
    SELECT media_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INTEGER - 1 AS pos FROM l""",
    over_cues=True,
)
def report_lines(spark, sf):
    """The Markdown lines of a small report of every medium."""
    d = F.col("end_ms") - F.col("start_ms")
    r = cues(spark, sf).groupBy("media_id").agg(
        F.count(F.lit(1)).alias("cues"), (F.count_if(tx.text(F.col("tgt_text")) == "") / F.count(F.lit(1))).alias("empty_ratio"),
        F.max(d).alias("longest_ms"), F.count_if(d < 834).alias("short_count"), F.lit(None).cast("long").alias("missing"),
    )
    some = F.array(
        F.when(F.col("empty_ratio") > 0.04, "many empty lines"), F.when(F.col("short_count") > 5, F.concat(F.lit("short cues: "), F.col("short_count").cast("string")))
    )
    r = r.withColumn("warnings", F.array_compact(some))
    return reports.markdown(r, "media_id", ["cues", "empty_ratio", "longest_ms", "short_count", "missing"])
