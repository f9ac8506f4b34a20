"""Normal forms of texts, keys of caches, and tolerant parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions import text as tx

SPACES = " \t\n\x0b\x0c\r"

# The patterns of the display rules, of evaluation and of model answers.
MARKUP = r"(?i)</?\s*(?:i|b|u|em|strong|font)(?:\s[^>]*)?>|\{\\[^}]*\}"
ELLIPSIS = r"(?:[…⋯‥]|\.{3,}|。{2,}|・{3,}|·{3,})+"
TERMINALS = r"([？！])[？！]+"
BREAKS = r"[，。]|(?<![0-9]),|,(?![0-9])"
QUOTED = '"([^"\\n]*)"'
EVALUATED = r"[\s\x{3000}、。！？!?,.・「」『』（）()\[\]【】~〜～…]+"
MATCHED = r"[^0-9a-z\x{3040}-\x{30ff}\x{3400}-\x{9fff}]+"
LOW_VALUE = r"^[。！？…、\s,.!?・「」（）【】；：\-—–]+$"
THOUGHT = r"(?is)<think>.*?</think>"
ANSWER_LABEL = r"(?i)^(?:Translation>\s*)?(?:Original>\s*)?"
ANSWER_QUOTES = "^['\"“”‘’]+|['\"“”‘’]+$"
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TERM_SIGNS = r"[,、。，？?\s]"


def stripped(c: Column) -> Column:
    """Without ASCII white space at the ends."""
    return F.btrim(tx.text(c), F.lit(SPACES))


def one_line(c: Column) -> Column:
    """Line ends and runs of blanks become one space; none at the ends."""
    return stripped(F.regexp_replace(F.translate(tx.text(c), "\r\n", "  "), "[ \t]+", " "))


def joined_lines(c: Column) -> Column:
    """Non-empty lines, trimmed, with single blanks, joined by a line feed."""
    even = F.regexp_replace(F.regexp_replace(tx.text(c), "[ \t]+", " "), "\r\n?", "\n")
    lines = F.transform(F.split(even, "\n"), stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def answer_text(c: Column) -> Column:
    """A model's answer without label and quotes, line feeds escaped; null when nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(stripped(c), ANSWER_LABEL, ""), ANSWER_QUOTES, "")
    return F.nullif(F.replace(joined_lines(bare), F.lit("\n"), F.lit("\\n")), F.lit(""))


def without_thoughts(c: Column) -> Column:
    """What follows the last closing tag of reasoning, without reasoning blocks."""
    return stripped(F.regexp_replace(F.regexp_replace(tx.text(c), THOUGHT, ""), "(?is)^.*</think>", ""))


def display_text(c: Column) -> Column:
    """The display rules: no markup, half-width digits, one ellipsis, full-width ends, a space for commas and periods."""
    t = F.translate(F.regexp_replace(tx.text(c), MARKUP, ""), "０１２３４５６７８９", "0123456789")
    t = F.regexp_replace(t, ELLIPSIS, "…")
    t = F.regexp_replace(F.translate(t, "?!", "？！"), TERMINALS, "$1")
    t = F.regexp_replace(F.regexp_replace(t, BREAKS, " "), QUOTED, "“$1”")
    lines = F.split(F.replace(t, F.lit("\\n"), F.lit("\n")), "\n")
    neat = lambda x: F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(x, r"[ \t\x{3000}]+", " ")), "、+$", ""))
    return F.array_join(F.filter(F.transform(lines, neat), lambda x: x != ""), "\n")


def evaluated(c: Column) -> Column:
    """Without the spaces and signs that do not count in an evaluation."""
    return F.regexp_replace(tx.text(c), EVALUATED, "")


def match_key(c: Column) -> Column:
    """Lower case, nothing in brackets, only ASCII letters and digits, kana and kanji."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(tx.text(c)), r"\[[^\]]*\]", " "), r"\([^)]*\)", " ")
    return F.regexp_replace(bare, MATCHED, "")


def low_value(c: Column) -> Column:
    """Nothing but spaces and signs."""
    return (tx.strip_punctuation(one_line(c)) == "") | F.regexp_like(one_line(c), F.lit(LOW_VALUE))


def safe_number(c: Column) -> Column:
    """A text as a finite double, else null; no suffixes, no names of numbers."""
    value = F.when(F.regexp_like(c, F.lit(NUMBER)), F.btrim(c, F.lit(SPACES)).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def first_text(*fields: Column) -> Column:
    """The first field that is not blank, cleaned; '' if none."""
    return F.coalesce(*(F.nullif(tx.clean(f), F.lit("")) for f in fields), F.lit(""))


def first_integer(doc: Column, *paths: str) -> Column:
    """The first of several paths of a JSON text that holds a number, as a whole number."""
    return F.coalesce(*(safe_number(F.get_json_object(doc, p)).cast("long") for p in paths))


def named_counts(c: Column) -> Column:
    """ "name=2,other=3" as a map; names trimmed, values at least 1, anything else left out; the last of a name wins."""
    parts = F.filter(F.split(tx.text(c), ","), lambda x: F.regexp_like(x, F.lit(r"^.*=\s*[0-9]+(\.[0-9]*)?\s*$")))
    pair = lambda x: F.struct(
        stripped(F.regexp_replace(x, "=[^=]*$", "")).alias("k"),
        F.greatest(F.lit(1), F.floor(safe_number(F.substring_index(x, "=", -1)))).cast("int").alias("v"),
    )
    pairs = F.transform(parts, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def model_family(c: Column) -> Column:
    """Lower case, up to the first colon."""
    return F.substring_index(F.lower(stripped(c)), ":", 1)


def prompt_signature(*parts: Column, effort: Column | None = None) -> Column:
    """12 hex digits over the settings of a prompt, one a line; a line for the effort only when there is one."""
    payload = F.array_join(F.array(*(tx.text(p) for p in parts)), "\n")
    if effort is not None:
        payload = F.concat(payload, F.when(tx.text(effort) != "", F.concat(F.lit("\nreasoning="), F.lower(stripped(effort)))).otherwise(""))
    return F.substring(F.sha1(payload), 1, 12)


def memory_key(source: Column, signature: Column) -> Column:
    """tm::signature::16 hex digits of the source in normal form."""
    return F.concat(F.lit("tm::"), signature, F.lit("::"), F.substring(F.sha1(joined_lines(source)), 1, 16))


def term_is_usable(c: Column, most: int = 8) -> Column:
    """A trimmed term that is not empty, not long, and without signs."""
    t = stripped(c)
    return (t != "") & (F.length(t) <= most) & ~F.regexp_like(t, F.lit(TERM_SIGNS))


def issue_subtype(mode: Column, nonlexical: Column, text: Column, seconds: Column, segments: Column, error: Column) -> Column:
    """Why an alignment needs a look, first rule first; normal modes have no issue of their own."""
    normal = F.lower(stripped(mode)).isin("", "boundary_proportional", "nonlexical", "ctc_forced_alignment")
    said = stripped(text)
    return (
        F.when(nonlexical, "nonlexical_text")
        .when((said == "") & (seconds >= 1.0), "asr_empty_text")
        .when((said != "") & (segments <= 0), "text_without_output_segment")
        .when(~normal, "unknown_alignment_mode")
        .when(tx.text(error) != "", "subtitle_timing_error")
        .otherwise("none")
    )


def snap_window_ms(duration_ms: Column) -> Column:
    """How far a weak cut may move: 250 ms up to 3 s, 400 ms up to 7 s, else 600 ms."""
    return F.when(duration_ms <= 3000, 250).when(duration_ms <= 7000, 400).otherwise(600)


def loop_guard(budget: Column, repeats: int = 3) -> tuple[Column, Column]:
    """(longest n-gram, least tokens) for a token budget: half the budget, shared among the repeats."""
    least = F.greatest(F.lit(repeats).cast("long"), F.ceil(budget * 0.5))
    return F.greatest(F.lit(1).cast("long"), F.floor(least / repeats)), least


def response_budget(chars: Column, items: Column) -> Column:
    """Tokens for an answer: 1.5 a character, 28 an item, 32 for the frame, 96 at least."""
    return F.greatest(F.lit(96).cast("long"), F.floor(chars * 1.5 + 28 * items + 32))
