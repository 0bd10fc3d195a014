"""Checks of mathematical spans: delimiters, braces, prose, flattened formulas, wrong encodings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

# Patterns and points of the screen for flattened formulas.
COMPACT_TOKEN = r"(?<![_^{}\\])\b(?:[A-Za-z]{2,}\d+|[A-Za-z]+\d{2,}|[A-Za-z]+\d+[A-Za-z]+\d+)\b"
PLAIN_NUMBER = r"(?:(?<=\s)|(?<=[=＋＝]))\d+(?:\.\d+)?(?=\s|$)"
FRAGMENT_LINE = r"(?:[A-Za-z]{1,4}|\d+(?:\.\d+)?|[=＋－+\-])"
BROKEN_EQUAL = r"=\s*="
FLATTENED_UNIT = r"(?<![\\^_{}A-Za-z])(?:m\s*/\s*s|N\s*/\s*kg|m\s*·\s*s)\s*\d+(?![A-Za-z0-9])"
FULLWIDTH_PUNCTUATION = r"[（），。＋－＝：；]"
FULLWIDTH_LABEL = r"（\s*\d+\s*）"
STRUCTURE = (
    r"(?:[_^{}]|\\(?:frac|dfrac|tfrac|sqrt|cdot|times|mathrm|text|operatorname|"
    r"sin|cos|tan|log|ln|Delta|alpha|beta|gamma|theta|mu|pi|sum|int|le|ge|approx|pm|perp|parallel)(?![A-Za-z]))"
)
TOKEN = r"[A-Za-z]+|\d+(?:\.\d+)?"
POINTS = {
    "digit_letter_flattening": 2,
    "isolated_number_fragments": 2,
    "fraction_like_broken_structure": 3,
    "flattened_unit_exponent": 1,
    "fullwidth_math_punctuation": 1,
    "orphan_equation_label": 2,
    "low_latex_structure_density": 1,
    "dense_alternating_tokens": 2,
}
WARN_FROM, FAIL_FROM = 3, 6


def delimiter_columns() -> dict[str, Column]:
    """The counts of each delimiter in `text`; inline ones after display ones are taken out."""
    bare = F.replace(F.col("text"), F.lit("$$"), F.lit(""))
    count = lambda rx, c="text": F.regexp_count(c, F.lit(rx)).cast("long")
    return {
        "display": ((F.char_length("text") - F.char_length(bare)) / 2).cast("long"), "inline": count(r"(?<!\\)\$(?!\$)", bare),
        "paren_open": count(r"(?<!\\)\\\("), "paren_close": count(r"(?<!\\)\\\)"), "bracket_open": count(r"(?<!\\)\\\["), "bracket_close": count(r"(?<!\\)\\\]"),
    }


def delimiter_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each delimiter."""
    return docs.select("doc_id", *[c.alias(k) for k, c in delimiter_columns().items()])


def unbalanced(display: Column, inline: Column, paren_open: Column, paren_close: Column, bracket_open: Column, bracket_close: Column) -> list[Column]:
    """The kinds of delimiters as conditions: an odd number of a symmetric one, another number of opening than of closing ones."""
    return [display % 2 == 1, inline % 2 == 1, paren_open != paren_close, bracket_open != bracket_close]


def delimiter_errors(counts: DataFrame) -> DataFrame:
    """doc_id, ord, error for each unbalanced kind."""
    said = [
        F.format_string("unbalanced display-math delimiters: %d occurrences of $$", "display"),
        F.format_string("unbalanced inline-math delimiters: %d unescaped $ markers", "inline"),
        F.format_string(r"unbalanced \\( \\) delimiters: %d open vs %d close", "paren_open", "paren_close"),
        F.format_string(r"unbalanced \\[ \\] delimiters: %d open vs %d close", "bracket_open", "bracket_close"),
    ]
    rules = zip(unbalanced(*[F.col(c) for c in ("display", "inline", "paren_open", "paren_close", "bracket_open", "bracket_close")]), said, strict=True)
    return counts.select("doc_id", F.posexplode(F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))).alias("ord", "error"))


def brace_positions(content: Column) -> Column:
    """struct(open, close): places (code points from 0) of unmatched unescaped braces, by a stack.

    Escaped characters are blanked first, which keeps places; then only braces are walked through."""
    blank = F.regexp_replace(content, r"\\[\s\S]", "  ")
    parts = F.transform(F.regexp_extract_all(blank, F.lit(r"[^{}]*[{}]"), F.lit(0)), lambda p: F.struct(F.char_length(p).alias("n"), (F.right(p, F.lit(1)) == "{").alias("up")))
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("open"), none.alias("close"))

    def step(acc: Column, p: Column) -> Column:
        here = acc["at"] + p["n"] - 1
        pops = ~p["up"] & (F.size(acc["open"]) > 0)
        opened = F.when(p["up"], F.concat(acc["open"], F.array(here))).when(pops, F.slice(acc["open"], 1, F.greatest(F.lit(0), F.size(acc["open"]) - 1))).otherwise(acc["open"])
        closed = F.when(~p["up"] & ~pops, F.concat(acc["close"], F.array(here))).otherwise(acc["close"])
        return F.struct((acc["at"] + p["n"]).alias("at"), opened.alias("open"), closed.alias("close"))

    done = F.aggregate(parts, start, step)
    return F.struct(done["open"].alias("open"), done["close"].alias("close"))


def brace_findings(spans: DataFrame) -> DataFrame:
    """Spans with unmatched braces: their columns, unmatched_open, unmatched_close, snippet."""
    d = spans.withColumn("_b", brace_positions(F.col("content")))
    d = d.withColumns({"unmatched_open": F.col("_b.open"), "unmatched_close": F.col("_b.close"), "snippet": T.snippet(F.col("content"))}).drop("_b")
    return d.filter((F.size("unmatched_open") > 0) | (F.size("unmatched_close") > 0))


def without_labels(content: Column) -> Column:
    """Content without its text labels; null stays null."""
    return F.regexp_replace(content, T.TEXT_LABEL, "")


def prose_findings(spans: DataFrame) -> DataFrame:
    """Spans with CJK text outside labels: their columns and a snippet."""
    return spans.filter(without_labels(F.col("content")).rlike(T.CJK)).withColumn("snippet", T.snippet(F.col("content"), 160))


def artifact_signals(content: Column, bare: Column | None = None) -> dict[str, Column]:
    """Each signal of a flattened formula as a condition. bare: the content without labels, where it is at hand."""
    bare = without_labels(content) if bare is None else bare
    count = lambda c, rx: F.regexp_count(c, F.lit(rx))
    fragments = F.filter(T.lines(bare), lambda x: T.strip(x).rlike(f"(?U)^{FRAGMENT_LINE}$"))
    hits = count(content, STRUCTURE)
    kinds = F.transform(F.regexp_extract_all(bare, F.lit("(?U)" + TOKEN), F.lit(0)), lambda t: t.rlike("^[A-Za-z]"))
    changes = F.size(F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(kinds))), lambda k: F.try_element_at(kinds, k) != F.try_element_at(kinds, k - 1)), lambda x: x))
    return {
        "digit_letter_flattening": bare.rlike("(?U)" + COMPACT_TOKEN),
        "isolated_number_fragments": (count(bare, "(?U)" + PLAIN_NUMBER) >= 2) & (F.char_length(bare) >= 20),
        "fraction_like_broken_structure": (F.size(fragments) >= 2) | (bare.rlike("(?U)" + BROKEN_EQUAL) & ~bare.contains("\\frac")),
        "flattened_unit_exponent": bare.rlike("(?U)" + FLATTENED_UNIT),
        "fullwidth_math_punctuation": bare.rlike(FULLWIDTH_PUNCTUATION),
        "orphan_equation_label": bare.rlike("(?U)" + FULLWIDTH_LABEL),
        "low_latex_structure_density": (F.char_length(bare) >= 24) & (hits <= 2) & bare.rlike("[A-Za-z]") & bare.rlike(r"(?U)\d"),
        "dense_alternating_tokens": (F.size(kinds) >= 7) & (changes >= 4) & (hits <= 3),
    }


def points(signals: dict[str, Column]) -> Column:
    return sum((F.when(signals[k], n).otherwise(0) for k, n in POINTS.items()), F.lit(0))


def artifact_scores(spans: DataFrame) -> DataFrame:
    """Display spans with score, signals (names) and snippet."""
    found = artifact_signals(F.col("content"))
    d = spans.filter("kind = 'display'").withColumns({f"_{k}": F.coalesce(c, F.lit(False)) for k, c in found.items()})
    score = points({k: F.col(f"_{k}") for k in POINTS})
    signals = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in POINTS]))
    return d.withColumns({"score": score.cast("int"), "signals": signals, "snippet": T.snippet(F.col("content"))}).drop(*[f"_{k}" for k in POINTS])


def artifact_findings(scores: DataFrame) -> DataFrame:
    """Scores from WARN_FROM up with their status."""
    return scores.filter(F.col("score") >= WARN_FROM).withColumn("status", F.when(F.col("score") >= FAIL_FROM, "FAIL").otherwise("WARN"))


#: How many items of evidence a signal shows at most.
SHOWN = {"digit_letter_flattening": 8, "isolated_number_fragments": 8, "fraction_like_broken_structure": 6, "flattened_unit_exponent": 8, "fullwidth_math_punctuation": 8, "orphan_equation_label": 4, "dense_alternating_tokens": 12}


def evidence(content: Column, bare: Column) -> Column:
    """The signals of a flattened formula: array<struct<id, score, evidence VARIANT>>, in the order of POINTS.

    Evidence is a list of what was found (some items at most), or an object of counts. bare: the content without labels."""
    found = lambda rx: F.regexp_extract_all(bare, F.lit(rx), F.lit(0))
    shown = lambda k, items: F.to_variant_object(F.slice(items, 1, SHOWN[k]))
    lines = F.filter(F.transform(T.lines(bare), T.strip), lambda x: x.rlike(f"(?U)^{FRAGMENT_LINE}$"))
    tokens = found("(?U)" + TOKEN)
    letters = F.transform(tokens, lambda t: t.rlike("^[A-Za-z]"))
    changes = F.size(F.filter(F.zip_with(F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), lambda x, y: x != y), lambda x: x))
    items = {
        "digit_letter_flattening": lambda k: shown(k, found("(?U)" + COMPACT_TOKEN)),
        "isolated_number_fragments": lambda k: shown(k, found("(?U)" + PLAIN_NUMBER)),
        "fraction_like_broken_structure": lambda k: T.once(lines, lambda x: shown(k, F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("spaced equality"))))),
        "flattened_unit_exponent": lambda k: shown(k, found("(?U)" + FLATTENED_UNIT)),
        "fullwidth_math_punctuation": lambda k: shown(k, found(FULLWIDTH_PUNCTUATION)),
        "orphan_equation_label": lambda k: shown(k, found("(?U)" + FULLWIDTH_LABEL)),
        "low_latex_structure_density": lambda k: F.to_variant_object(F.struct(F.regexp_count(content, F.lit(STRUCTURE)).alias("structure_hits"))),
        "dense_alternating_tokens": lambda k: F.to_variant_object(F.struct(F.slice(tokens, 1, SHOWN[k]).alias("tokens"), changes.alias("transitions"))),
    }
    holds = artifact_signals(content, bare)
    return F.array_compact(F.array(*[F.when(F.coalesce(holds[k], F.lit(False)), F.struct(F.lit(k).alias("id"), F.lit(n).alias("score"), items[k](k).alias("evidence"))) for k, n in POINTS.items()]))


#: The codecs that are tried, in order, and what a recovered text must have one of.
CODECS = ("gbk", "gb18030")
TELLING = r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f{}\[\](),;:=+\-*/^_]"


def recover(runs: pd.Series) -> pd.DataFrame:
    """recovered and codec by run: what it says if it is UTF-8 that was read by one of the codecs; nulls if it isn't.

    Each distinct run is looked at once; the codecs make columns of which the first that makes sense is taken."""
    number, distinct = pd.factorize(runs, use_na_sentinel=False)
    distinct = [x if isinstance(x, str) else "" for x in distinct]
    asked = pd.Series(distinct, dtype=object)
    raw = {codec: asked.map(lambda x, codec=codec: x.encode(codec, "replace")) for codec in CODECS}
    said = pd.DataFrame({codec: r.map(lambda x: x.decode("utf-8", "replace")) for codec, r in raw.items()}, dtype=object)
    # nothing was replaced on either way
    exact = pd.DataFrame({codec: [t.encode("utf-8", "replace") == r and r.count(b"?") == x.count("?") for t, r, x in zip(said[codec], raw[codec], asked, strict=True)] for codec in CODECS}, dtype=bool)
    plain = said.apply(lambda c: c.str.translate({9: "", 10: "", 13: ""}).map(str.isprintable).astype(bool) & ~c.str.contains("\ufffd") & c.str.contains(TELLING))
    good = exact & plain & said.ne(asked, axis=0)
    first = [next((c for c in CODECS if ok[c]), None) for ok in good.to_dict("records")]
    found = pd.DataFrame({"recovered": [said.at[k, c] if c else None for k, c in enumerate(first)], "codec": first}, dtype=object)
    return found.iloc[number].reset_index(drop=True) if len(found) else pd.DataFrame({"recovered": [None] * len(runs), "codec": [None] * len(runs)}, dtype=object)


def _recovered(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    yield from map(recover, batches)


def _recovered_lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For each list of runs what its runs say and by which codec; nulls for those that are as they should be."""
    for lists in batches:
        runs = pd.Series(lists.to_numpy(), index=range(len(lists))).explode().dropna()
        found = recover(runs)
        rows = pd.Series(list(zip(found["recovered"], found["codec"], strict=True)), index=runs.index, dtype=object)
        by_list = rows.groupby(level=0).agg(list) if len(rows) else rows
        yield pd.DataFrame({"runs": [[{"recovered": r, "codec": c} for r, c in by_list.get(k, [])] for k in range(len(lists))]})


def recovered_runs(runs: Column) -> Column:
    """array<struct<recovered, codec>> for an array of runs; the codecs are Python's."""
    return F.pandas_udf(_recovered_lists, "runs array<struct<recovered: string, codec: string>>")(runs)["runs"]


def _how_many(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in batches:
        runs = lists.reset_index(drop=True).explode().dropna()
        found = recover(runs)["recovered"].notna().to_numpy()
        yield pd.Series(found, index=runs.index).groupby(level=0).sum().reindex(range(len(lists)), fill_value=0).astype("int64")


def mojibake_count(runs: Column) -> Column:
    """How many of an array of runs are wrongly decoded UTF-8."""
    return F.pandas_udf(_how_many, "long")(runs)


def mojibake_findings(cjk_runs: DataFrame) -> DataFrame:
    """Runs (of scans.cjk_runs) that are wrongly decoded UTF-8: their columns, recovered, codec. The codecs are Python's."""
    recovered = F.pandas_udf(_recovered, "recovered string, codec string")
    d = cjk_runs.withColumn("_r", recovered("run")).filter(F.col("_r.recovered").isNotNull())
    return d.withColumns({"recovered": F.col("_r.recovered"), "codec": F.col("_r.codec")}).drop("_r")
