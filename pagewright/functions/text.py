"""Text functions with the semantics of Unicode text: code points, Unicode white space, any line end."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns of the document format, in Java's dialect.
PAGE_MARKER = r"(?U)<!--\s*PDF page\s+(\d+)(?:\s*\|\s*printed page\s+(\d+|unknown))?\s*-->"
RUNNER_PAGE_MARKER = r"(?U)<!--\s*PDF page\s+(\d+)\s*-->"
IMAGE = r"(?U)!\[([^\]]*)\]\((?:<([^>]+)>|([^\s)]+))(?:\s+[^)]*)?\)"
HEADING = r"(?U)^(#{1,6})\s+(.*?)\s*$"
DISPLAY_MATH = r"\$\$([\s\S]*?)\$\$"
INLINE_MATH = r"(?<!\$)\$(?!\$)([^$\n]*?)(?<!\\)\$(?!\$)"
PAREN_MATH = r"\\\(([\s\S]*?)(?<!\\)\\\)"
BRACKET_MATH = r"\\\[([\s\S]*?)(?<!\\)\\\]"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}]"
TEXT_LABEL = r"(?U)\\(?:text|mathrm|operatorname)\s*\{[^{}]*\}"
NOTE = r"(?i)\[Transcription note:"
PRIVATE_USE = r"[\x{e000}-\x{f8ff}\x{f0000}-\x{ffffd}\x{100000}-\x{10fffd}]"
RUNNER_PRIVATE_USE = r"[\x{e000}-\x{f8ff}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
URL = r"^(?i:[a-z][a-z0-9+.-]*:|//)"
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "svg", "gif")
# Words in the Unicode names of letters that textbooks are expected to have.
EXPECTED_SCRIPTS = ("LATIN", "GREEK", "CJK UNIFIED IDEOGRAPH", "CJK COMPATIBILITY", "HIRAGANA", "KATAKANA", "MICRO SIGN", "IDEOGRAPHIC ITERATION MARK")
RUNNER_EXPECTED_SCRIPTS = ("LATIN", "GREEK", "CJK UNIFIED", "CJK COMPATIBILITY", "HIRAGANA", "KATAKANA", "MICRO SIGN", "IDEOGRAPHIC ITERATION MARK")

#: White space as str.split() and str.strip() know it.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, whatever f does with it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@lru_cache
def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Full case folding from the database: characters that fold to one, what they fold to, and those that fold to several."""
    pairs = [(ch, f) for ch in map(chr, range(sys.maxunicode + 1)) if (f := ch.casefold()) != ch]
    one = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in one), "".join(b for _, b in one), [(a, b) for a, b in pairs if len(b) > 1]


def casefold(c: Column) -> Column:
    """Full case folding, as str.casefold() has it: the key on which names meet that differ in case alone."""
    one, to, several = _folds()
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several])
    wide = lambda x: F.when(x.rlike("[" + "".join(a for a, _ in several) + "]"), F.aggregate(listed, x, lambda acc, p: F.replace(acc, p["a"], p["b"]))).otherwise(x)
    # ASCII, which most names are, folds to lower case
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(once(c, wide), one, to)).otherwise(F.lower(c))


@lru_cache
def _decimals() -> tuple[str, str]:
    """All decimal digits but the ASCII ones, and their values."""
    found = [(ch, str(v)) for ch in map(chr, range(128, sys.maxunicode + 1)) if (v := unicodedata.decimal(ch, None)) is not None]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def integer(c: Column) -> Column:
    """The number that a text is, as int() reads it: digits of any script, single underscores between them, a sign, white space
    around. Null if it isn't one or goes beyond 64 bits."""
    said = lambda x: F.when(x.rlike(r"^[+-]?\d+(?:_\d+)*$"), F.replace(x, F.lit("_"), F.lit(""))).try_cast("bigint")
    around = re.sub("[\x1c-\x1f]", "", SPACES)  # white space, but not what separates records
    return once(F.translate(F.btrim(c, F.lit(around)), *_decimals()), said)


def before(values: Column) -> Column:
    """For each element of an array of numbers the sum of those before it.

    Elements are summed up in runs first, so the work goes with the power 3/2 of their number at most (for some 10^5 of them)."""
    run, add = 64, lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    runs = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / run).cast("int"))
    sums = F.transform(runs, lambda r: add(F.slice(values, r * run + 1, F.lit(run))))
    whole = F.transform(F.array(sums), lambda s: F.transform(runs, lambda r: add(F.slice(s, 1, r))))
    at = lambda w, k: F.get(w, F.floor(k / run).cast("int")) + add(F.slice(values, F.floor(k / run).cast("int") * run + 1, (k % run).cast("int")))
    found = F.flatten(F.transform(whole, lambda w: F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda k: at(w, k))))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast("array<bigint>"))


def snippet(c: Column, most: int = 200) -> Column:
    """Runs of white space as one space, trimmed, at most so many code points."""
    return F.substring(F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " ")), 1, most)


def compact(c: Column) -> Column:
    """Runs of spaces, tabs and wide or hard spaces as one space, trimmed."""
    return strip(F.regexp_replace(c, "[ \t\u00a0\u2002\u2003]+", " "))


def filled_lines(c: Column) -> Column:
    """The lines of a text that aren't empty, each as `compact` has it. Blanks become one in the whole text at once, since none of them
    ends a line; single spaces are passed over."""
    blanks = F.regexp_replace(c, "[ \t\u00a0\u2002\u2003]{2,}|[\t\u00a0\u2002\u2003]", " ")
    return F.filter(F.transform(F.split(blanks, LINE_END, -1), strip), lambda x: x != "")


def lines(c: Column) -> Column:
    """The lines of a text without their ends; no last empty one."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


@lru_cache
def unexpected_letters(expected: tuple[str, ...] = EXPECTED_SCRIPTS) -> str:
    """A Java pattern of one letter whose Unicode name has none of these words; its ranges are made from the database.

    Java tries the ranges one by one, so a look-ahead first passes over Latin letters and ideographs, where there are none but two."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if ch.isalpha() and (name := unicodedata.name(ch, "")) and not any(w in name for w in expected):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "(?=[ªº\\x{2b0}-\\x{33ff}\\x{4dc0}-\\x{4dff}\\x{a000}-\\x{10ffff}])[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" if a < b else rf"\x{{{a:x}}}" for a, b in ranges) + "]"


def find(df: DataFrame, keys: list[str], text: str, pattern: str, groups: dict[str, int]) -> DataFrame:
    """One row for each match: keys, seq (from 0), start (code points before it), line (line ends before it, plus 1), and groups.

    A text is split at the matches; starts are running sums over its pieces, so the text itself doesn't go on from here.
    Groups that take no part are empty strings."""
    p = F.lit(pattern)
    width = {name: F.regexp_extract_all(text, p, F.lit(g)) for name, g in {"_whole": 0, **groups}.items()}
    hits = df.filter(F.col(text).rlike(pattern)).select(*keys, F.split(text, pattern, -1).alias("_pieces"), *[c.alias(n) for n, c in width.items()])
    zipped = F.arrays_zip(F.slice("_pieces", 1, F.size("_pieces") - 1).alias("_piece"), *[F.col(n) for n in width])
    rows = hits.select(*keys, F.posexplode(zipped).alias("seq", "m"))
    rows = rows.select(*keys, "seq", F.char_length("m._piece").alias("_p"), F.char_length("m._whole").alias("_w"), F.regexp_count("m._piece", F.lit("\n")).alias("_pn"), F.regexp_count("m._whole", F.lit("\n")).alias("_wn"), *[F.col("m")[n].alias(n) for n in groups])
    before = Window.partitionBy(*keys).orderBy("seq")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("_p").over(before) + F.coalesce(F.sum("_w").over(past), F.lit(0))
    line = F.sum("_pn").over(before) + F.coalesce(F.sum("_wn").over(past), F.lit(0)) + 1
    return rows.select(*keys, "seq", start.cast("long").alias("start"), line.cast("long").alias("line"), *groups)


def matches(text: Column, pattern: str, groups: dict[str, int], when: Column) -> Column:
    """The matches in a text as array<struct<seq, start, line, groups>>, as `find` has them as rows; looked for only where `when` holds.

    The text is split once and matched once for each group; starts are sums over the lengths of pieces and matches."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(whole), F.lit(0)))
    parts = F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), *[F.regexp_extract_all(text, p, F.lit(g)).alias(n) for n, g in groups.items()])

    def placed(found: Column) -> Column:
        place = lambda size: once(F.transform(found, lambda m: size(m["piece"])), lambda own: F.zip_with(before(F.zip_with(own, F.transform(found, lambda m: size(m["whole"])), lambda x, y: x + y)), own, lambda x, y: x + y))
        starts = place(lambda x: F.char_length(x).cast("long"))
        lines = place(lambda x: F.regexp_count(x, F.lit("\n")).cast("long"))
        rows = lambda z: F.transform(z, lambda m, k: F.struct(k.alias("seq"), m["start"].alias("start"), (m["line"] + 1).alias("line"), *[m["m"][n].alias(n) for n in groups]))
        return once(F.arrays_zip(starts.alias("start"), lines.alias("line"), found.alias("m")), rows)

    kind = ", ".join(f"{n}: STRING" for n in groups)
    return F.when(when, once(parts, placed)).otherwise(F.expr(f"CAST(array() AS ARRAY<STRUCT<seq: INT, start: BIGINT, line: BIGINT, {kind}>>)"))


def decoded(c: Column) -> Column:
    """Percent-decoding that keeps `+` and what isn't well formed."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def normal_path(c: Column) -> Column:
    """A relative path without `.` and `..`; null if it leaves its root or is absolute."""
    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        skip = (part == ".") | (part == "")
        gone = acc["bad"] | (up & (F.size(acc["at"]) == 0))
        at = F.when(skip, acc["at"]).when(up, F.slice(acc["at"], 1, F.greatest(F.lit(0), F.size(acc["at"]) - 1))).otherwise(F.concat(acc["at"], F.array(part)))
        return F.struct(at.alias("at"), gone.alias("bad"))

    first = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("bad"))
    done = F.aggregate(F.split(c, "/"), first, step)
    # most paths have no part to take out
    return F.when(~c.rlike(r"(^|/)\.{0,2}(/|$)"), c).otherwise(F.when(~c.startswith("/") & ~done["bad"], F.array_join(done["at"], "/")))
