"""Text functions on Columns.

Predicates give false for NULL. Patterns are regular expressions; POSIX classes such as ``[[:alpha:]]`` and
references such as ``\\\\1`` are understood. With ``fixed`` a pattern is literal text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.core import as_column, order_columns

#: POSIX character classes in Java's words.
CLASSES = {"alpha": r"\p{L}", "digit": r"\p{Nd}", "alnum": r"\p{L}\p{Nd}", "space": r"\s", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "punct": r"\p{Punct}", "blank": r" \t", "xdigit": r"0-9A-Fa-f", "cntrl": r"\p{Cntrl}"}
#: Words that titles keep small.
SMALL_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "en", "for", "if", "in", "is", "nor", "not", "of", "on", "or", "per", "so", "the", "v[.]?", "via", "vs", "from", "into", "than", "that", "to", "with")
#: Letters that Unicode doesn't take apart, and what stands for them.
STROKED = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i", "ĸ": "k", "ŋ": "n", "Ŋ": "N"}
#: Letters that are a Latin letter with marks.
MARKED = {c: d[0] for c in map(chr, range(0xC0, 0x2000)) if (d := unicodedata.normalize("NFD", c))[0].isascii() and len(d) > 1 and all(map(unicodedata.combining, d[1:]))}
WHITE = "[ \\t\\r\\n]"


def java(pattern: str, fixed: bool = False) -> str:
    """A pattern in Java's syntax."""
    return re.escape(pattern) if fixed else re.sub(r"\[:(\w+):\]", lambda m: CLASSES[m[1]], pattern)


def _replacement(text: str, fixed: bool) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$") if fixed else re.sub(r"\\(\d)", r"$\1", text)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def trim(c) -> Column:
    return F.regexp_replace(as_column(c), f"^{WHITE}+|{WHITE}+$", "")


def squish(c) -> Column:
    """Trimmed, and white space in between as one blank."""
    return F.regexp_replace(trim(c), r"\s+", " ")


def lower(c) -> Column:
    return F.lower(as_column(c))


def upper(c) -> Column:
    return F.upper(as_column(c))


def titlecase(c) -> Column:
    """Words capitalized, but for small words that aren't the first."""
    small = "^(" + "|".join(SMALL_WORDS) + ")$"
    words = F.split(F.lower(as_column(c)), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.rlike(small), w).otherwise(F.initcap(w))), " ")


def sentencecase(c) -> Column:
    x = as_column(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def textlen(c) -> Column:
    return F.char_length(as_column(c))


def left(c, n: int) -> Column:
    return F.substring(as_column(c), 1, n)


def right(c, n: int) -> Column:
    return F.right(as_column(c), F.lit(n))


def middle(c, start: int, end: int) -> Column:
    """From ``start`` to ``end``, both included."""
    return F.substring(as_column(c), start, max(0, end - start + 1))


def truncate(c, n: int, ellipsis: str = "...") -> Column:
    x = as_column(c)
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n - len(ellipsis)), F.lit(ellipsis))).otherwise(x)


def _pad(n: Column, pad: str) -> Column:
    return F.repeat(F.lit(pad), F.greatest(n, F.lit(0)).cast("int"))


def padleft(c, width: int, pad: str = " ") -> Column:
    """At least ``width`` characters; never cut. ``pad`` is repeated once for each missing character."""
    x = as_column(c)
    return F.concat(_pad(width - F.char_length(x), pad), x)


def padright(c, width: int, pad: str = " ") -> Column:
    x = as_column(c)
    return F.concat(x, _pad(width - F.char_length(x), pad))


def padcenter(c, width: int, pad: str = " ") -> Column:
    x = as_column(c)
    n = F.greatest(width - F.char_length(x), F.lit(0))
    return F.concat(_pad(F.floor(n / 2), pad), x, _pad(n - F.floor(n / 2), pad))


def contains(c, pattern: str, fixed: bool = False) -> Column:
    x = as_column(c)
    return _true(x.contains(pattern) if fixed else x.rlike(java(pattern)))


def matches(c, pattern: str, fixed: bool = False) -> Column:
    """The whole text: the pattern between ^ and $ (an alternation is anchored at its ends only)."""
    x = as_column(c)
    return _true(x == pattern if fixed else x.rlike(f"^{java(pattern)}$"))


def startswith(c, pattern: str, fixed: bool = False) -> Column:
    x = as_column(c)
    return x.startswith(pattern) if fixed else _true(x.rlike(f"^{java(pattern)}"))


def endswith(c, pattern: str, fixed: bool = False) -> Column:
    x = as_column(c)
    return x.endswith(pattern) if fixed else _true(x.rlike(f"{java(pattern)}$"))


def countmatch(c, pattern: str, fixed: bool = False) -> Column:
    return F.regexp_count(as_column(c), F.lit(java(pattern, fixed)))


def locateall(c, pattern: str, fixed: bool = False) -> Column:
    """Places (from 1) of all matches; -1 alone if there are none."""
    around = F.lit(rf"(?s)\G(.*?)({java(pattern, fixed)})")
    x = as_column(c)
    found = F.arrays_zip(F.regexp_extract_all(x, around, F.lit(1)).alias("gap"), F.regexp_extract_all(x, around, F.lit(2)).alias("hit"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("places"))

    def step(s: Column, m: Column) -> Column:
        here = s["at"] + F.length(m["gap"])
        return F.struct((here + F.length(m["hit"])).alias("at"), F.concat(s["places"], F.array(here)).alias("places"))

    places = F.aggregate(found, start, step)["places"]
    return F.when(F.size(places) > 0, places).when(x.isNotNull(), F.array(F.lit(-1)))


def locate(c, pattern: str, fixed: bool = False) -> Column:
    """Place (from 1) of the first match, or -1."""
    at = F.regexp_instr(as_column(c), F.lit(java(pattern, fixed)))
    return F.when(at == 0, F.lit(-1)).otherwise(at)


def extract(c, pattern: str) -> Column:
    """The first match; NULL where there is none."""
    x, p = as_column(c), java(pattern)
    return F.when(x.rlike(p), F.regexp_extract(x, p, 0))


def extractall(c, pattern: str) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(java(pattern)), F.lit(0))


def extractnum(c) -> Column:
    return F.regexp_replace(as_column(c), "[^0-9.-]", "").try_cast("double")


def extractint(c) -> Column:
    return F.regexp_replace(as_column(c), "[^0-9-]", "").try_cast("int")


def extractbetween(c, left: str, right: str) -> Column:
    """What is between the last ``left`` that fits and the last ``right``; the input itself without a match."""
    return F.regexp_replace(as_column(c), f".*{java(left)}(.*){java(right)}.*", "$1")


def replacetext(c, pattern: str, replacement: str, fixed: bool = False) -> Column:
    return F.regexp_replace(as_column(c), java(pattern, fixed), _replacement(replacement, fixed))


def removetext(c, pattern: str, fixed: bool = False) -> Column:
    return F.regexp_replace(as_column(c), java(pattern, fixed), "")


removeall = removetext


def splittext(c, sep: str, fixed: bool = False) -> Column:
    """Pieces, without an empty one at the end."""
    pieces = F.split(as_column(c), java(sep, fixed))
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def splitfirst(c, sep: str, fixed: bool = False) -> Column:
    return F.get(splittext(c, sep, fixed), F.lit(0))


def splitlast(c, sep: str, fixed: bool = False) -> Column:
    pieces = splittext(c, sep, fixed)
    return F.get(pieces, F.size(pieces) - 1)


def jointext(*cols) -> Column:
    """Texts one after another; NULL is written NA."""
    return F.concat(*(F.coalesce(as_column(c).cast("string"), F.lit("NA")) for c in cols))


def collapsetext(c, sep: str = "", *, order) -> Column:
    """An aggregate: all values in row order as one text; NULL is written NA."""
    keys = [F.col(o) if isinstance(o, str) else o for o in ([order] if isinstance(order, (str, Column)) else order)]
    order_columns(order)
    entry = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.coalesce(as_column(c).cast("string"), F.lit("NA")).alias("v"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["v"]), sep)


def isblank(c) -> Column:
    """NULL, NaN or white space only."""
    x = as_column(c).cast("string")
    return x.isNull() | (x == "NaN") | x.rlike(f"^{WHITE}*$")


def removeaccents(c) -> Column:
    """Latin letters without their marks, in plain ASCII; combining marks go. Letters of other scripts stay."""
    single = MARKED | {k: v for k, v in STROKED.items() if len(v) == 1}
    text = F.translate(as_column(c), "".join(single), "".join(single.values()))
    for mark, plain in STROKED.items():
        if len(plain) > 1:
            text = F.replace(text, F.lit(mark), F.lit(plain))
    return F.regexp_replace(text, r"[\u0300-\u036f]", "")


transliterate = removeaccents


def normalizeunicode(c) -> Column:
    """The text as it is."""
    return as_column(c)


def normalizeencoding(c) -> Column:
    """Valid UTF-8: bytes that aren't become the replacement character."""
    return F.make_valid_utf8(as_column(c))


def textdist(x: DataFrame, y: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """Levenshtein distances between all texts of two tables, as rows (x, y, distance)."""
    a, b = x.select(F.col(x_col).alias("x")), y.select(F.col(y_col).alias("y"))
    return a.crossJoin(b).withColumn("distance", F.levenshtein("x", "y"))


def nearesttext(c, choices: Sequence[str]) -> Column:
    """The choice with the least Levenshtein distance, the first of several."""
    x = as_column(c)
    entries = F.array(*(F.struct(F.levenshtein(x, F.lit(t)).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(choices)))
    return F.when(x.isNotNull(), F.array_min(entries)["t"])


similartext = nearesttext


def _shape(pattern: str, doc: str):
    def test(c) -> Column:
        return _true(as_column(c).rlike(pattern))

    test.__doc__ = doc
    return test


isalpha = _shape(r"^\p{L}+$", "Letters only.")
isalphanumeric = _shape(r"^[\p{L}\p{Nd}]+$", "Letters and digits only.")
isnumerictext = _shape(r"^[+-]?([0-9]*[.])?[0-9]+$", "A decimal number.")
isintegertext = _shape(r"^[+-]?[0-9]+$", "A whole number.")
isemail = _shape(r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "Has the form local@domain.tld.")
isurl = _shape(r"^(https?|ftp)://", "Begins with a web or FTP scheme.")
