"""Text scalar functions as column expressions.

Everything stays on the JVM inside the scan's stage, except HTML entities
(``unescape_html``) and Python's title case, which are Arrow-batched.
White space means what a Unicode-aware strip removes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "<SEP>"
UNKNOWN_SOURCE = "unknown_source"
WS = r"[\s\u000b\u001c-\u001f\u0085\p{Z}]"
MAX_FILE_PATH_BYTES = 32768

# Full-width forms and their half-width counterparts.
FULL_WIDTH = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９－＋／＊（）—　"
HALF_WIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-+/*()- "
CJK = r"[一-龥]"
ASCII_MARK = r"[a-zA-Z0-9()\[\]@#$%!&*\-=+_]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+$", "")


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    import html

    return s.map(lambda x: html.unescape(x) if x and "&" in x else x)


def sanitize(c: Column) -> Column:
    """Encodable text without control characters, entities resolved, trimmed."""
    text = F.regexp_replace(strip(c), r"[\x{FFFE}\x{FFFF}\x{D800}-\x{DFFF}]", "")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return strip(F.regexp_replace(unescape_html(text), r"[\x00-\x1f\x7f-\x9f]", ""))


def normalize(c: Column, inner_quotes: bool = False) -> Column:
    """A cleaned name or description; ``inner_quotes`` also removes quotes inside."""
    x = F.regexp_replace(c, r"(?i)</p\s*>|<p\s*>|<p/>", "")
    x = F.regexp_replace(x, r"(?i)</br\s*>|<br\s*>|<br/>", "")
    x = F.translate(x, FULL_WIDTH, HALF_WIDTH)
    x = F.regexp_replace(x, f"(?<={CJK}){WS}+(?={CJK})", "")
    x = F.regexp_replace(x, f"(?<={CJK}){WS}+(?={ASCII_MARK})", "")
    x = F.regexp_replace(x, f"(?<={ASCII_MARK}){WS}+(?={CJK})", "")
    for left, right in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")):
        x = F.regexp_replace(x, rf"\A{left}([^{left}{right}]*){right}\z", "$1")
    if inner_quotes:
        x = F.regexp_replace(x, "[“”‘’]", "")
        x = F.regexp_replace(x, f"['\"]+(?={CJK})", "")
        x = F.regexp_replace(x, f"(?<={CJK})['\"]+", "")
        x = F.translate(x, " ", " ")
        x = F.regexp_replace(x, "(?<=[^0-9]) ", " ")
    # Short numbers are no names: up to two digits, or up to five digits and dots with a dot.
    return F.regexp_replace(strip(x), r"\A(?:[0-9]{1,2}|(?=[0-9]*\.)[0-9.]{1,5})\z", "")


def clean(c: Column, inner_quotes: bool = False) -> Column:
    return normalize(sanitize(c), inner_quotes)


def split_markers(c: Column, markers: list[str]) -> Column:
    """Parts between literal markers, trimmed, without empty ones; null gives one part, ''."""
    pattern = "|".join("\\Q" + m + "\\E" for m in markers)
    parts = F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")
    return F.when(c.isNull(), F.array(F.lit(""))).otherwise(parts)


def is_float(c: Column) -> Column:
    return c.rlike(r"\A[-+]?[0-9]*\.?[0-9]+\z")


def summary(c: Column, most: int = 250) -> Column:
    x = strip(c)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def without_thinking(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)^(<think>.*?</think>|.*</think>)", ""))


def with_time(description: Column, label: Column) -> Column:
    """Description with its time label in front, unless it starts with it."""
    put = F.length(strip(F.coalesce(label, F.lit("")))) > 0
    return F.when(put & ~description.startswith(label), F.concat(F.lit("[Time: "), label, F.lit("] "), description)).otherwise(description)


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def valid_type(c: Column) -> Column:
    return (F.length(c) > 0) & ~c.rlike(r"['()<>|/\\]")


@F.pandas_udf(T.StringType())
def decode_unicode(s: pd.Series) -> pd.Series:
    """``\\uXXXX`` escapes as characters."""
    import re

    pattern = re.compile(r"\\u([0-9a-fA-F]{4})")
    return s.map(lambda x: x if x is None else pattern.sub(lambda m: chr(int(m[1], 16)), x))


def first_json(c: Column) -> Column:
    """From the first opening to the last closing brace; null without them."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def keywords(c: Column) -> Column:
    """Struct of the high and low level keyword lists of a model's answer."""
    return F.from_json(first_json(c), "high_level_keywords array<string>, low_level_keywords array<string>")


def tables(c: Column) -> Column:
    """Complete HTML tables in order, case ignored."""
    return F.regexp_extract_all(c, F.lit(r"(?is)(<table[^>]*>.*?</table>)"), 1)


def joined_paths(existing: Column, new: Column, most: int = MAX_FILE_PATH_BYTES) -> Column:
    """Existing paths as they are, then unseen new ones while the bytes stay under the limit."""
    start = F.filter(existing, lambda x: x.isNotNull() & (x != ""))
    unseen = F.array_except(F.array_distinct(F.filter(new, lambda x: x.isNotNull() & (x != ""))), start)
    put = lambda acc, x: F.when(acc != "", F.concat(acc, F.lit(SEP), x)).otherwise(x)
    return F.aggregate(unseen, F.array_join(start, SEP), lambda acc, x: F.when(F.octet_length(put(acc, x)) < most - 5, put(acc, x)).otherwise(acc))


def year_and_quarter(c: Column) -> Column:
    """Struct of ``year`` and ``quarter`` of a time; pass ``current_timestamp()`` for today's."""
    return F.struct(F.year(c).alias("year"), F.quarter(c).alias("quarter"))


def literal_id(place: Column, text: Column) -> Column:
    """Id of a text that was passed as such: its place from 0 and the start of its md5."""
    return F.concat(F.lit("text_"), place.cast("string"), F.lit("_"), F.substring(F.md5(text), 1, 16))


def record_id(prefix: str, *parts: Column) -> Column:
    """Prefix and md5 of the parts joined without a separator."""
    return F.concat(F.lit(prefix), F.md5(F.concat(*[p.cast("string") for p in parts])))


def cache_key(mode: Column, kind: Column, digest: Column) -> Column:
    return F.concat_ws(":", mode, kind, digest)


def parse_cache_key(c: Column) -> Column:
    """Struct of mode, type and hash; null unless there are three parts."""
    p = F.split(c, ":", 3)
    return F.when(F.size(p) == 3, F.struct(p[0].alias("mode"), p[1].alias("cache_type"), p[2].alias("digest")))


# The default tokenizer: one CJK character, or a maximal run of other characters without white space.
TOKEN = r"[\u4e00-\u9fff]|[^\s\u4e00-\u9fff]+"
SPAN = rf"(?:{TOKEN})\s*"
_PYTHON_TOKEN = None
#: A caller's tokenizer: the (start, end) places of the tokens of a text.
Tokenizer = Callable[[str], list[tuple[int, int]]]


def default_spans(text: str) -> list[tuple[int, int]]:
    """The default tokenizer in Python, with the JVM's white space."""
    global _PYTHON_TOKEN
    import re

    _PYTHON_TOKEN = _PYTHON_TOKEN or re.compile(r"[\u4e00-\u9fff]|[^ \t\n\x0b\f\r\u4e00-\u9fff]+")
    return [m.span() for m in _PYTHON_TOKEN.finditer(text)]


def words(c: Column) -> Column:
    """Tokens of the default tokenizer."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def spans(c: Column) -> Column:
    """Tokens with the white space behind them: joined, they are the text."""
    return F.regexp_extract_all(c, F.lit(SPAN), F.lit(0))


def joined(parts: Column) -> Column:
    """The stretch of text that consecutive ``spans`` are, without white space at its end."""
    return F.regexp_replace(F.array_join(parts, ""), r"\s+$", "")


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def n_tokens(c: Column, tokenizer: Tokenizer | None = None) -> Column:
    """Tokens of a text by the default tokenizer, or by a caller's in Arrow batches."""
    if tokenizer is None:
        return n_words(c)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else len(tokenizer(x))).astype("Int32")

    return F.pandas_udf(run, "int")(c)
