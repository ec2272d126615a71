"""Lines that structure a regulation or a Markdown text, as patterns and native predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import CJK

# Numerals and the forms of articles, chapters, headings and list items.
NUMBER = r"[一二三四五六七八九十百千零〇\d]+"
ARTICLE = rf"^\s*(第\s*{NUMBER}\s*條(?:\s*之\s*{NUMBER})?)(?=\s|$)"
CHAPTER = rf"^\s*(第\s*{NUMBER}\s*章)(?=\s|$)"
HEADING = r"^(#{1,3})\s+(\S.*)$"
LIST_ITEM = r"^\s*(\d+[.、)]|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十\d]+[）)]|[-*•・]\s)"
_JAVA = "(?U)"  # white space and digits of all scripts, as Python's patterns have them


def is_article(line: Column) -> Column:
    return line.rlike(_JAVA + ARTICLE)


def is_chapter(line: Column) -> Column:
    return line.rlike(_JAVA + CHAPTER)


def is_heading(line: Column) -> Column:
    """An article, a chapter or a Markdown heading of up to three signs."""
    return is_article(line) | is_chapter(line) | line.rlike(_JAVA + HEADING)


def is_list_item(line: Column) -> Column:
    return line.rlike(_JAVA + LIST_ITEM)


def join_wrapped(lines: Column) -> Column:
    """An array of lines in which those that a page's width has cut are whole again. A line goes on unless it ends with a
    sentence sign, either is blank or a heading, or the next is a list item. Nothing stands between them beside a wide
    character or after a hyphen, else one space. Null lines are blank."""
    blank = " \t\n\r\0\x0b"
    trimmed = lambda x: F.btrim(x, F.lit(blank))

    def step(state: Column, line: Column) -> Column:
        last, line = state["open"], F.coalesce(line, F.lit(""))
        goes_on = (trimmed(last) != "") & (trimmed(line) != "") & ~last.rlike("[。！？；：!?;:.][」』\"')）]*$") & ~is_heading(last) & ~is_heading(line) & ~is_list_item(line)
        rest = F.ltrim(line, F.lit(blank))
        close = last.rlike("[A-Za-z]-$") | F.right(last, F.lit(1)).rlike(CJK) | F.left(rest, F.lit(1)).rlike(CJK)
        joined = F.struct(state["done"].alias("done"), F.concat(last, F.when(close, "").otherwise(" "), rest).alias("open"))
        begun = F.struct(F.when(last.isNull(), state["done"]).otherwise(F.array_append(state["done"], last)).alias("done"), line.alias("open"))
        return F.when(F.coalesce(goes_on, F.lit(False)), joined).otherwise(begun)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(lines, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))
