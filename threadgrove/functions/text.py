"""Text cleaning and small string rules as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Brand and model words removed from texts, tried in this order, case ignored.
STOP_LIST = [
    "小米", "苹果", "三星", "荣耀", "华为", "一加",
    "oppo", "OPPO", "vivo", "realme", "红米", "真我", "安卓",
    "x7pro", "x100s", "gt5pro", "GTneo5", "pro", "手机", "11", "12", "13", "14", "备用机",
    "p40",
]
UNKNOWN = "<unk>"  # fixed values: placeholders
EMPTY = "<empty_text_placeholder>"
MIN_LENGTH = 5
# The characters stripped from both ends, all that Unicode or ASCII call white space.
SPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
         "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
OTHER_CASE = {"s": "\u017f", "k": "\u212a"}  # fixed values: further characters that equal a letter when case is ignored
PREVIEW = 100


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def stop_pattern(words: list[str]) -> str:
    """Pattern for any of the words, tried in order, case ignored.

    A look at the first character lets the engine skip almost every position of a text at once.
    """
    first = {v for w in words for v in (w[0], w[0].lower(), w[0].upper(), OTHER_CASE.get(w[0].lower(), w[0]))}
    return f"(?=[{''.join(re.escape(c) for c in sorted(first))}])(?iu:" + "|".join(re.escape(w) for w in words) + ")"


def clean_text(col, stop_list: list[str] | None = None) -> Column:
    """Drop [bracketed] spans, @mentions and stop words, then strip white space; NULL becomes ''."""
    words = STOP_LIST if stop_list is None else stop_list
    out = F.coalesce(_c(col), F.lit(""))
    out = F.regexp_replace(out, r"(?d)\[.*?\]", "")
    out = F.regexp_replace(out, r"(?U)@\S+\s?", "")
    if words:
        out = F.regexp_replace(out, stop_pattern(words), "")
    return F.trim(out, F.lit(SPACE))


def text_or(col, default: str = UNKNOWN) -> Column:
    """The text, or a default when it is missing or empty."""
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(default))


def long_enough(col, minimum: int = MIN_LENGTH) -> Column:
    """At least `minimum` code points."""
    return F.length(_c(col)) >= minimum


def preview(col, size: int = PREVIEW) -> Column:
    """First `size` characters, with an ellipsis only when something is left out."""
    c = _c(col)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def fraction_of(col) -> Column:
    """`…_frac0.1` gives 0.1; anything that does not split into two parts gives 0."""
    parts = F.split(_c(col), "_frac")
    found = F.when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("double"))
    return F.when(_c(col).isNotNull(), F.coalesce(found, F.lit(0.0)))


def threshold_of_path(col) -> Column:
    """Threshold in a path segment such as `sim_0.75`, or NULL."""
    return F.regexp_extract(_c(col), r"sim_([0-9]*\.?[0-9]+)", 1).try_cast("double")


def words(col) -> Column:
    """Default tokenizer: runs of characters without white space."""
    return F.filter(F.split(_c(col), r"\s+"), lambda w: w != "")
