"""Text column functions, all native Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.stopwords import ENGLISH

# Patterns that decide which tokens, URLs and characters count.
TOKEN = r"[\p{L}\p{N}_]{2,}"
NOT_ALNUM_OR_SPACE = r"[^a-zA-Z0-9\s\x0b\x1c-\x1f\x85\p{Z}]+"
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
URL_START = r"^https?://"
PROPERTY_PREFIX = r"https?://(www\.)?|sc-domain:"
REQUEST_NOISE = r"[^a-zA-Z0-9:/,.\-]"
SECTION_KEY = r"%%([^%]+)%%:"
PATH_SEPARATOR = " > "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A column used inside a lambda may be inlined by the optimizer and then be
    computed again for every element; a lambda variable holds its value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_spaces(text: Column) -> Column:
    """Trim any leading and trailing white space, not only blanks."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def tokenize(text: Column, stop_words: Iterable[str] = ENGLISH) -> Column:
    """Lower-cased word tokens of two or more characters, stop words removed."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    words = sorted(set(stop_words))
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """Every run of ``lo`` to ``hi`` tokens, joined by one space.

    Tokens are read by position: ``slice`` would copy the whole array per run.
    """
    none = F.array().cast("array<string>")

    def runs(t: Column, n: int) -> Column:
        size = F.size(t)
        starts = F.sequence(F.lit(0), size - n)
        joined = F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)])
        )
        return F.when(size >= n, joined).otherwise(none)

    return let(tokens, lambda t: F.concat(*[runs(t, n) for n in range(lo, hi + 1)]))


def distinct_words(text: Column) -> Column:
    """Drop repeated words, keeping the order of first use."""
    return F.array_join(F.array_distinct(F.split(text, " ")), " ")


def word_count(text: Column) -> Column:
    return F.size(F.split(text, " "))


def remove_terms(text: Column, terms: Iterable[str], phrases: bool = False) -> Column:
    """Remove words equal to one of ``terms``, ignoring case.

    Words are split on single spaces, so a term of several words matches
    nothing unless ``phrases`` is on, which first drops whole phrases.
    """
    wanted = sorted({t.lower().strip() for t in terms})
    if not wanted:
        return text
    if phrases:
        for phrase in sorted((t for t in wanted if " " in t), key=len, reverse=True):
            pattern = F.lit(r"(?i)(?<!\S)\Q" + phrase.replace(r"\E", "") + r"\E(?!\S)\s?")
            text = F.regexp_replace(text, pattern, F.lit(""))
    kept = F.filter(F.split(text, " "), lambda w: ~F.lower(w).isin(wanted))
    return F.array_join(kept, " ")


def split_response(text: Column) -> Column:
    """Comma-separated names to an array of trimmed names."""
    return F.transform(F.split(text, ","), strip_spaces)


def path_text(path: Column) -> Column:
    """Category path string to its space-joined text."""
    return F.array_join(F.split(path, PATH_SEPARATOR), " ")


def path_levels(path: Column) -> Column:
    return F.split(path, PATH_SEPARATOR)


def parse_sections(text: Column) -> Column:
    """``%%key%%: value`` text to a map.

    A key line opens a section whose first value is what follows the line's
    first colon; other lines are added to the open section.  Lines of a section
    are trimmed and joined by a blank line, a repeated key starts afresh, and
    text before the first key is ignored.
    """
    lines = F.split(text, r"\n+")
    start = F.struct(
        F.create_map().cast("map<string,array<string>>").alias("sections"),
        F.lit(None).cast("string").alias("key"),
    )

    def put(sections: Column, key: Column, values: Column) -> Column:
        others = F.map_filter(sections, lambda k, _: k != key)
        return F.map_concat(others, F.map_from_arrays(F.array(key), F.array(values)))

    def step(acc: Column, line: Column) -> Column:
        return let(F.regexp_extract(line, SECTION_KEY, 1), lambda k: turn(acc, line, k))

    def turn(acc: Column, line: Column, key: Column) -> Column:
        first = F.regexp_replace(line, r"^[^:]*:", "")
        opened = F.struct(
            put(acc["sections"], key, F.array(first)).alias("sections"),
            key.alias("key"),
        )
        more = F.concat(acc["sections"][acc["key"]], F.array(line))
        added = F.struct(
            put(acc["sections"], acc["key"], more).alias("sections"),
            acc["key"].alias("key"),
        )
        return (
            F.when(key != "", opened).when(acc["key"].isNotNull(), added).otherwise(acc)
        )

    folded = F.aggregate(lines, start, step)["sections"]
    return F.transform_values(
        folded,
        lambda _, v: strip_spaces(F.array_join(F.transform(v, strip_spaces), "\n\n")),
    )


def parse_request(text: Column) -> Column:
    """``property, days`` text to struct(property, days, error)."""
    parts = F.split(F.regexp_replace(text, REQUEST_NOISE, ""), ",")
    days = F.when(F.size(parts) == 2, parts[1].try_cast("int"))
    good = days.isNotNull()
    return F.struct(
        F.when(good, parts[0]).alias("property"),
        days.alias("days"),
        F.when(~good | good.isNull(), F.lit("Error: expected two parts: property, days")).alias("error"),
    )


def outline_paths(text: Column) -> Column:
    """Indented outline text to an array of ``A > B`` paths.

    The level of a line is the position of its indent among the distinct
    indents of the text.  A path is emitted for entries below the top level
    of the running path only.
    """
    raw = F.filter(F.split(text, "\n"), lambda x: strip_spaces(x) != "")
    lines = F.transform(
        raw,
        lambda x: F.struct(
            F.length(F.regexp_extract(x, r"(?U)^(\s*)", 1)).alias("depth"),
            strip_spaces(F.replace(strip_spaces(x), F.lit("-"), F.lit(""))).alias("name"),
        ),
    )
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("path"), none.alias("out"))

    def step(depths: Column, acc: Column, line: Column) -> Column:
        level = F.array_position(depths, line["depth"]).cast("int") - 1
        keep = F.least(F.size(acc["path"]), level)
        path = F.concat(F.slice(acc["path"], F.lit(1), keep), F.array(line["name"]))
        return let(
            path,
            lambda p: F.struct(
                p.alias("path"),
                F.when(
                    F.size(p) > 1,
                    F.concat(acc["out"], F.array(F.array_join(p, PATH_SEPARATOR))),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )

    def fold(ls: Column) -> Column:
        depths = F.array_sort(F.array_distinct(F.transform(ls, lambda x: x["depth"])))
        return let(
            depths,
            lambda d: F.aggregate(ls, start, lambda acc, line: step(d, acc, line))["out"],
        )

    return let(lines, fold)
