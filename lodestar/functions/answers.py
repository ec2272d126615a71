"""Citation markers, answers and conversations as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import neutral_tags

# A marker, the numbers in one, signs before which no space stays, and the answer that tells of no sources.
MARKER = r"[\[［]([^\[\]［］\n]{1,20})[\]］]"
_NUMBERS = r"(?U)^\d+(?:\s*[,，、\-–~～－]\s*\d+)*$"
_PART = r"(?U)(\d+)(?:\s*[\-–~～－]\s*(\d+))?"
SPACE_BEFORE_SIGN = r"[ \t　]+(?=[。，、；：！？.,;:!?\n]|$)"
INSUFFICIENT = "資料不足"
SOURCE_LINE = r"(?mU)^\s*(資料來源[:：]?.*|\[\d+\](\[\d+\])*\s+\S+\.(pdf|txt|md)\b.*)$"
REWRITE_PREFIX = r"(?U)^\s*(改寫後的問題|改寫後|問題)\s*[:：]\s*"
_FULL_ALNUM = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_MOST = 9223372036854775807


def citation_markers(text: Column) -> Column:
    """Bracketed markers of 1 to 20 characters without brackets or line ends."""
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))


def citation_numbers(marker: Column) -> Column:
    """The distinct numbers of a marker such as ``[1]``, ``[1, 3]`` or ``[2-4, 7]``, full-width ones too; null if it holds
    anything else. A range that goes backwards or over 20 numbers is its start."""
    body = F.btrim(F.translate(F.regexp_replace(marker, r"^[\[［]|[\]］]$", ""), _FULL_ALNUM, _ALNUM))
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(_MOST))

    def expanded(part: Column) -> Column:
        low, high = number(F.regexp_extract(part, _PART, 1)), F.regexp_extract(part, _PART, 2)
        top = F.when(high == "", low).otherwise(number(high))
        return F.when((top >= low) & (top - 20 < low), F.sequence(low, F.when((top >= low) & (top - 20 < low), top).otherwise(low))).otherwise(F.array(low))

    parts = F.regexp_extract_all(body, F.lit(_PART), F.lit(0))
    return F.when(body.rlike(_NUMBERS), F.array_distinct(F.flatten(F.transform(parts, expanded))))


def is_insufficient(answer: Column, message: str = INSUFFICIENT) -> Column:
    """Whether an answer, without markers and opening signs, starts with the message that sources are lacking."""
    t = F.regexp_replace(F.regexp_replace(answer, r"[\[［][^\]］\n]{1,20}[\]］]", ""), r"(?U)^[\s「『*#　]+", "")
    return t.startswith(message)


def without_citations(answer: Column) -> Column:
    """An answer for later turns: no source lines, no markers, no space before signs, one blank line for several."""
    t = F.regexp_replace(F.regexp_replace(answer, SOURCE_LINE, ""), MARKER, "")
    t = F.regexp_replace(F.regexp_replace(t, "(?m)" + SPACE_BEFORE_SIGN, ""), r"\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \t\n\r\0\x0b"))


def citation_label(document: Column, section: Column, first: Column, last: Column) -> Column:
    """document, section and pages with wide spaces between; an empty section leaves no gap."""
    pages = F.when(first == last, F.concat(F.lit("第 "), first.cast("string"), F.lit(" 頁"))).otherwise(F.concat(F.lit("第 "), first.cast("string"), F.lit("–"), last.cast("string"), F.lit(" 頁")))
    return F.btrim(F.regexp_replace(F.concat_ws("　", document, F.coalesce(section, F.lit("")), pages), r"(?U)(　|\s){2,}", "　"))


def rewrite_message(history: Column, question: Column) -> Column:
    """The prompt that asks for a question that stands alone; history array<struct<question, answer>>."""
    neutral = lambda x: neutral_tags(x, "history")
    turns = F.array_join(F.transform(history, lambda t: F.concat(F.lit("使用者："), neutral(t["question"]), F.lit("\n助理："), neutral(t["answer"]))), "\n")
    return F.concat(F.lit("<history>\n"), turns, F.lit("\n</history>\n\n最後的問題："), neutral(question))


def clean_rewrite(content: Column) -> Column:
    """A rewritten question without prefix and quotation marks."""
    t = F.btrim(F.regexp_replace(F.btrim(content), REWRITE_PREFIX, ""))
    return F.regexp_replace(t, "(?U)^[\\s「『\"“']+|[\\s」』\"”']+$", "")


def rewrite_status(rewritten: Column, question: Column, most: int = 200, message: str = INSUFFICIENT) -> Column:
    """fallback_<reason>, unchanged (equal but for white space, punctuation and symbols) or rewritten."""
    bare = lambda x: F.regexp_replace(x, r"(?U)[\s\p{P}\p{S}]+", "")
    return (
        F.when(rewritten == "", "fallback_empty").when(F.char_length(rewritten) > most, "fallback_too_long").when(F.contains(rewritten, F.lit(message)), "fallback_looks_like_answer")
        .when(bare(rewritten) == bare(question), "unchanged").otherwise("rewritten")
    )


def evaluation_query(mode: str, history: Column, question: Column, rewritten: Column) -> Column:
    """What an evaluation searches for: the question (none), with those before it (concat), or its rewriting (llm)."""
    if mode == "concat":
        return F.array_join(F.concat(F.transform(history, lambda t: t["question"]), F.array(question)), " ")
    return rewritten if mode == "llm" else question


def section_matches(wanted: Column, section: Column) -> Column:
    """A wanted section is the last part of ``a / b / c``; a null one matches any."""
    return F.coalesce(wanted.isNull() | (F.element_at(F.split(F.coalesce(section, F.lit("")), " / "), -1) == wanted), F.lit(False))


def answer_passes(kind: Column, insufficient: Column, called: Column, n_citations: Column) -> Column:
    """no_answer needs an insufficient answer, partial a call with citations, others a sufficient one with citations; an
    answer that failed (null) does not pass."""
    good = F.when(kind == "no_answer", insufficient).when(kind == "partial", called & (n_citations > 0)).otherwise(~insufficient & (n_citations > 0))
    return F.coalesce(good, F.lit(False))


def json_count(document: Column, path: str, strict: bool = False) -> Column:
    """A token count in a JSON text at a dotted path: 0 where it is missing; where it is negative or not whole null, or, if
    ``strict``, an error."""
    got = F.get_json_object(document, "$." + path)
    wrong = F.raise_error(F.concat(F.lit(f"invalid token count {path}: "), got)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(got.isNull(), F.lit(0).cast("long")).when(got.rlike(r"^\d{1,18}$"), got.try_cast("long")).otherwise(wrong)
