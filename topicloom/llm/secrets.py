"""Secret scan: fixed patterns, and guess-cost dynamic programming for passwords.

Three patterns give base spans: assignments to credential names, access keys
and long hex runs.  Values in a wider credential context (other names, "is" or
"to" as the link, any characters) are segmented into dictionary words, dates,
repeats, keyboard walks and brute-force characters at the least total cost in
log10 guesses, but for values of letters only after a bare space and a few
words of prose.  A context may begin inside a value.  A value that costs at least ``MIN_GUESSES`` becomes a further
span of kind ``guess``, unless a base span has it.  Base spans always stay.

Offsets are code points, ends exclusive.  Null text counts as empty and has no
spans.  Every row gives one result, also with a null or repeated id.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")

#: log10 of the guesses from which a value counts as a real password, and its least length.
MIN_GUESSES = 8.0
MIN_LENGTH = 8

#: Longest span of one pattern (word, date, repeat, walk); brute force has no limit.
PATTERN_CHARS = 40

# Words that passwords are often made of, commonest first.
WORDS = """
password pass admin letmein welcome monkey dragon master login abc qwerty football baseball iloveyou
sunshine princess shadow superman michael jennifer jordan hunter trustno hello freedom whatever ninja
access flower hottie loveme secret summer winter spring autumn cheese coffee computer internet killer
pepper ginger cookie banana orange purple yellow silver golden diamond thunder tiger lion eagle falcon
love money test demo guest user root server system database default changeme temp example sample
company office london paris berlin madrid soccer hockey batman pokemon starwars matrix charlie thomas
""".split()
# Letters that stand for others in passwords, and key rows.
LEET = str.maketrans("4@8(310!5$7+2", "aabceioisstt" + "z")
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")

RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
WALKS = {a + b for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Longer names come first.
CONTEXT = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:api|access|private|secret)[_ -]?key|pass[_ -]?(?:word|wd|phrase|code)|pass|pwd|secret|token"
    r"|credentials?|bearer)[\"'`]?(\x20*(?:[:=]|=>|->)\x20*|\x20+(?:is|was|to)(?:\x20*[:=]\x20*|\x20+)|\x20+)[\"'`]?(?=[^\s\"'`<>,;])",
    re.IGNORECASE | re.ASCII,
)
VALUE_END = re.compile(r"[\s\"'`<>,;]|\Z", re.ASCII)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "bearer")
# Words of prose after "password is" or "secret to", no values.
PROSE = set("""
required incorrect invalid expired protected necessary mandatory optional accepted rejected encrypted available unavailable
something everything anything everyone happiness becoming remember confirm continue complete correct generated unlocked
""".split())
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)?\d\d)")


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``."""
    n = len(value)
    low, leet = value.lower(), value.lower().translate(LEET)
    if len(low) != n:  # a letter whose lower case is longer: no patterns over it
        low = leet = value
    kinds = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10), (lambda c: not c.isalnum(), 33))
    size = sum(k for test, k in kinds if any(map(test, value)))
    per_char = math.log10(max(size, 10))
    best = [0.0] + [math.inf] * n

    def offer(i: int, j: int, cost: float) -> None:
        best[j] = min(best[j], best[i] + cost + (math.log10(2) if i else 0.0))

    for i in range(n):
        best[i + 1] = min(best[i + 1], best[i] + per_char)
        for j in range(i + 3, min(n, i + 16) + 1):
            word = low[i:j]
            rank = RANK.get(word)
            changed = 0.0 if value[i:j] == word else 0.5
            if rank is None:
                rank, changed = RANK.get(leet[i:j]), 1.0
            if rank:
                offer(i, j, math.log10(rank) + changed)
        for m in [DATE.match(low, i)]:
            if m:
                offer(i, m.end(), math.log10(200 if m.end() - i == 4 else 365 * 200))
        j = i + 1
        while j < min(n, i + PATTERN_CHARS) and low[j - 1 : j + 1] in WALKS:
            j += 1
            if j - i >= 3:
                offer(i, j, math.log10(60 * (j - i)))
        for unit in range(1, 7):
            j = i + unit
            while j + unit <= min(n, i + PATTERN_CHARS) and low[j : j + unit] == low[i : i + unit]:
                j += unit
                if j - i >= 3:
                    offer(i, j, unit * per_char + math.log10((j - i) // unit))
    return best[n]


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], float]:
    """(start, kind, end) of all spans in order, and the highest guess cost of added ones."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    top = 0.0
    if any(w in low for w in CONTEXT_WORDS):
        base = sorted(found)
        starts, ends = [s for s, _, _ in base], [0, *accumulate((e for _, _, e in base), max)]
        stop = end = done = 0
        for m in CONTEXT.finditer(text):  # ends before the value, so a value may hold the next context
            start, link = m.end(), m[1].strip()
            if start >= stop:
                stop = end = VALUE_END.search(text, start).start()
                while end > start and text[end - 1] in ".!?)]}":
                    end -= 1
            if end - start < MIN_LENGTH or end <= done or ends[bisect_right(starts, start)] >= end:
                continue  # short, or another span has it
            value = text[start:end]
            if not link and value.rstrip(":=").isalpha() or link.isalpha() and value.lower() in PROSE:
                continue
            cost = guess_cost(value)
            if cost >= MIN_GUESSES:
                found.append((start, 3, end))
                top, done = max(top, cost), end
    return sorted(found), top


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and, per row: spans array<struct<kind,start,end>>, guess_log10 (highest of the added)."""

    @F.pandas_udf("spans array<struct<kind:string,start:long,end:long>>, guess_log10 double")
    def scan(texts: pd.Series) -> pd.DataFrame:
        got = [spans_of(t) if t else ([], 0.0) for t in texts]
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans, _ in got]
        return pd.DataFrame({"spans": rows, "guess_log10": [g for _, g in got]})

    return docs.select(F.col(id_col), scan(F.col(text_col)).alias("_found")).select(id_col, "_found.spans", "_found.guess_log10")


def span_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as one string."""
    spans = F.col("spans")
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        F.col(id_col),
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(F.filter(spans, lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        written(spans).alias("spans"),
        "guess_log10",
    )
