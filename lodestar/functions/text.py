"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Characters that count as one token each in estimates: CJK signs, ideographs with their extension A and
#: compatibility forms, full-width and half-width forms.
CJK = "[\u3000-\u303f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef]"
#: Han characters, CJK signs and full-width forms: no white space stands beside them in search text.
HAN = r"[\p{IsHan}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
#: Numerals in numbers of articles, and what may be numbered.
NUMERALS, NUMBERED = "[零〇一二兩三四五六七八九十百千]+", "條|章|節|款|項"
#: All that a page-number line may hold.
PAGE_NUMBER = r"^[\s0-9\-–—|/.:：第頁共次PpAaGgEeOoFf]*$"
_FULL = "".join(chr(c) for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(a, b + 1))
_HALF = "".join(chr(ord(c) - 0xFEE0) for c in _FULL)


def once(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def replaced(text: Column, pattern: str, f) -> Column:
    """text with each match of the pattern replaced by f(match), natively: its pieces and its matches, in turn."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(pieces, F.transform(found, f), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


def halfwidth(text: Column) -> Column:
    """Full-width digits and letters to ASCII; a full-width hyphen between ASCII letters or digits to ``-``."""
    return F.regexp_replace(F.translate(text, _FULL, _HALF), "(?<=[A-Za-z0-9])－(?=[A-Za-z0-9])", "-")


def token_estimate(text: Column, cjk: float = 1.0, other: float = 0.3) -> Column:
    """ceil(CJK characters x cjk + other characters x other)."""
    wide = F.regexp_count(text, F.lit(CJK))
    return F.ceil(wide * F.lit(cjk) + (F.length(text) - wide) * F.lit(other)).cast("long")


def clean_lines(text: Column, keeps_layout: bool = False) -> Column:
    """Half-width digits and letters; line ends to LF; NBSP and tabs to spaces, none at a line's end, and one for several behind
    a character. With ``keeps_layout``, as for Markdown, lines stay as they are."""
    t = F.when(text.rlike("[\uff0d-\uff5a]"), halfwidth(text)).otherwise(text)  # most texts have none
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    if keeps_layout:
        return t
    return F.regexp_replace(F.regexp_replace(F.translate(t, "\u00a0\t", "  "), "(?m) +$", ""), r"(?<=\S) {2,}", " ")


def squeeze_blank_lines(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "\n{3,}", "\n\n"), F.lit("\n"))


def is_page_number(line: Column) -> Column:
    """A line of digits, page signs and white space, with a digit at least."""
    return line.rlike(PAGE_NUMBER) & line.rlike("[0-9]")


def line_signature(line: Column) -> Column:
    """What repeats from page to page: the trimmed line, or of a page-number line # for its digits, without white space."""
    numbers = F.regexp_replace(F.regexp_replace(line, r"\s", ""), "[0-9]+", "#")
    return F.when(is_page_number(line), numbers).otherwise(F.btrim(line))


def numeral_value(numeral: Column) -> Column:
    """The number of a Chinese numeral: a digit counts times the unit behind it, a unit alone once."""
    step = lambda s, c: F.when(
        F.instr(F.lit("零一二三四五六七八九"), c) > 0, F.struct(s["total"].alias("total"), (F.instr(F.lit("零一二三四五六七八九"), c) - 1).alias("digit"))
    ).otherwise(F.struct((s["total"] + F.greatest(s["digit"], F.lit(1)) * F.when(c == "十", 10).when(c == "百", 100).otherwise(1000)).alias("total"), F.lit(0).alias("digit")))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))
    return F.aggregate(F.split(F.translate(numeral, "〇兩", "零二"), ""), start, step, lambda s: s["total"] + s["digit"])


def _numbered(text: Column) -> Column:
    """Chinese numerals in numbers of articles and their branches as digits, without white space."""
    whole = rf"(?U)第\s*({NUMERALS})\s*({NUMBERED})(?:\s*之\s*({NUMERALS}))?"
    branch = rf"(?U)(條|章)\s*之\s*({NUMERALS})"
    part = lambda m, p, i: F.regexp_extract(m, p, i)
    number = lambda m, p, i: numeral_value(part(m, p, i)).cast("string")
    t = replaced(text, whole, lambda m: F.concat(F.lit("第"), number(m, whole, 1), part(m, whole, 2), F.when(part(m, whole, 3) != "", F.concat(F.lit("之"), number(m, whole, 3))).otherwise("")))
    return once(t, lambda x: replaced(x, branch, lambda m: F.concat(part(m, branch, 1), F.lit("之"), number(m, branch, 2))))


def search_text(text: Column) -> Column:
    """Index and query form: half-width, articles' numbers in digits, no white space beside Han characters and one space
    for several elsewhere, lower case, no - or _ inside codes."""
    han = lambda t: F.regexp_replace(_numbered(t), rf"(?U)\s+(?={HAN})|(?<={HAN})\s+", "")
    t = once(text, lambda x: F.when(x.rlike(HAN), once(halfwidth(x), han)).otherwise(x))  # most texts have no such character
    t = F.lower(F.btrim(F.regexp_replace(t, r"(?U)\s{2,}|[^\S ]", " ")))
    return F.regexp_replace(t, "[-_](?<=[a-z0-9].)(?=[a-z0-9])", "")


def exact_terms(text: Column) -> Column:
    """Terms that search text must hold as they are, each once, of two characters at least: numbers of articles, codes of
    three letters and digits or more with one of each, and what stands in quotation marks."""
    articles = F.regexp_extract_all(text, F.lit(r"第\d+(?:條|章)(?:之\d+)?"), F.lit(0))
    codes = F.filter(F.regexp_extract_all(text, F.lit("[a-z0-9]{3,}"), F.lit(0)), lambda x: x.rlike("[a-z]") & x.rlike("[0-9]"))
    quoted = F.regexp_extract_all(text, F.lit('[「『"“]([^」』"”]{2,30})[」』"”]'), F.lit(1))
    return F.array_distinct(F.concat(articles, codes, quoted))


def bigrams(text: Column) -> Column:
    """All overlapping pairs of characters."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"sk-[A-Za-z0-9_\-]{8,}", "sk-***"), r"AIza[A-Za-z0-9_\-]{8,}", "AIza***")


def neutral_tags(text: Column, tag: str) -> Column:
    """<tag> and </tag> in any case with full-width brackets, so that content can't close its frame."""
    return F.regexp_replace(text, f"(?i)<(/?){tag}>", f"＜$1{tag}＞")
