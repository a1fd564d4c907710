"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned windows: the
turns that start in the same stretch of ``capacity`` tokens form one window,
except that a turn reaching over its end is a window of its own.  A window so
holds at most the budget; only a single turn can be longer, and is kept whole.
Every window repeats the leading system turn and the turns that start in the
``history`` tokens before it.  A system turn that would leave less than
``1/NEW_SHARE`` of the budget to new turns is a turn as any other: it stands in
its place, whole, and no later window repeats it.  Targets are the assistant texts that are new in
a window; repeated ones are masked, so each is learned once.

A turn is written ``<|turn|>role<|text|>text<|end|>``.  In roles and texts a
backslash is doubled and every control string gets a backslash inside, so none
is left and reading back is exact.

Prefix sums are taken in blocks of ``BLOCK_TURNS`` turn numbers, whose totals
are summed first, so no task sorts a whole long conversation; history and
system turns come by equality joins.  Only the digest of a conversation, by its
nature one value, gathers it.

Defined cases: null roles and texts count as empty.  Rows with a null
conversation id are one conversation; null turns come first; equal turn numbers
are ordered by role and text, and equal rows all stay.  An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import null_key
from topicloom.runtime import materialize

BUDGET = 1024
HISTORY = 192
TURN_TOKENS = 4
BLOCK_TURNS = 512
#: One part in so many of each window is left to new turns, at least.
NEW_SHARE = 4

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of chat templates that never stand in a text unescaped.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Double backslashes and break every control string with one."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def count_tokens(text: Column) -> Column:
    """Default measure of a text: its words and single marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, tokens: Column | None, most: int) -> DataFrame:
    """key, conv, idx, role, text, tokens, before (tokens of all earlier turns) and lead (tokens of a leading system turn of at most ``most``)."""
    text = F.coalesce(text_col, F.lit(""))
    plain = turns.select(
        null_key(conv_col).alias("key"),
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        text.alias("text"),
        ((count_tokens(text) if tokens is None else F.coalesce(tokens, F.lit(0))) + TURN_TOKENS).cast("long").alias("tokens"),
        F.coalesce(F.floor(F.col(turn_col) / BLOCK_TURNS), F.lit(-(1 << 60))).alias("block"),
    )
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = plain.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), F.min(F.struct("turn", "role", "text", "tokens")).alias("lead"))
    lead = F.first("lead").over(Window.partitionBy("key").orderBy("block"))
    blocks = blocks.select(
        "key",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"),
        F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("sum"),
        F.when((lead["role"] == "system") & (lead["tokens"] <= most), lead["tokens"]).otherwise(F.lit(0)).alias("lead"),
    )
    own = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    here = plain.withColumn("at", F.row_number().over(own) - 1).withColumn(
        "upto", F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    joined = here.join(blocks, ["key", "block"])
    return joined.select(
        "key", "conv", (F.col("first") + F.col("at")).alias("idx"), "role", "text", "tokens", (F.col("sum") + F.col("upto") - F.col("tokens")).alias("before"), "lead"
    )


def chat_windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history: int = HISTORY, target_role: str = "assistant", tokens: Column | None = None,
) -> DataFrame:
    """conv, window, formatted, loss (spans in code points), n_repeated and n_tokens of every window.

    ``window`` numbers rise along a conversation and may have gaps.  The first
    ``n_repeated`` turns of a window are repeated ones.
    """
    if history < 1 or budget <= history:
        raise ValueError("the budget must be larger than the history, which is at least 1")
    numbered = numbered_turns(turns, conv_col, turn_col, role_col, text_col, tokens, budget - history - budget // NEW_SHARE)
    leads = (F.col("idx") == 0) & (F.col("lead") > 0)
    start = F.when(leads, F.lit(0)).otherwise(F.col("before") - F.col("lead"))
    size = F.when(leads, F.lit(0)).otherwise(F.col("tokens"))
    led = numbered.withColumn("capacity", F.greatest(budget - history - F.col("lead"), F.lit(1)))
    led = led.withColumn("start", start).withColumn("stretch", F.floor(start / F.col("capacity")))
    over = F.col("start") + size > (F.col("stretch") + 1) * F.col("capacity")
    own = led.select("key", "conv", "idx", "role", "text", "tokens", "start", (2 * F.col("stretch") + over.cast("long")).alias("window"), leads.alias("leads"))
    own = materialize(own, "turns")
    system = own.where("leads").select("key", F.col("role").alias("s_role"), F.col("text").alias("s_text"), F.col("tokens").alias("s_tokens"))

    spans = own.groupBy("key", "conv", "window").agg(F.min("start").alias("from"), F.min("idx").alias("first"))
    later = spans.where("first > 0")
    near = F.floor(F.col("from") / history)
    asked = later.select("key", "conv", "window", "from", "first", F.explode(F.array(near - 1, near)).alias("stretch"))
    told = own.where("NOT leads").select("key", "idx", "role", "text", "tokens", "start", F.floor(F.col("start") / history).alias("stretch"))
    repeated = asked.join(told, ["key", "stretch"]).where((F.col("start") >= F.col("from") - history) & (F.col("idx") < F.col("first")))
    retained = later.join(system, "key")

    columns = ["key", "conv", "window", "idx", "role", "text", "tokens"]
    rows = own.select(*columns, F.lit(False).alias("seen"))
    rows = rows.unionByName(repeated.select(*columns, F.lit(True).alias("seen")))
    kept = retained.select("key", "conv", "window", F.lit(0).cast("long").alias("idx"), F.col("s_role").alias("role"), F.col("s_text").alias("text"), F.col("s_tokens").alias("tokens"), F.lit(True).alias("seen"))
    rows = rows.unionByName(kept)

    written = rows.select(
        "key", "conv", "window", "idx", "seen", "tokens",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("body"),
        ((F.col("role") == target_role) & ~F.col("seen")).alias("target"),
    )
    parts = written.groupBy("key", "conv", "window").agg(
        F.sort_array(F.collect_list(F.struct("idx", "head", "body", "target", "seen"))).alias("parts"), F.sum("tokens").alias("n_tokens")
    )
    lengths = F.transform("parts", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long"))

    def loss(p: Column, i: Column) -> Column:
        begin = F.aggregate(F.slice(F.col("lengths"), F.lit(1), i), F.lit(0).cast("long"), lambda a, n: a + n) + F.length(p["head"])
        return F.struct(begin.alias("start"), (begin + F.length(p["body"])).alias("end"), p["target"].alias("target"))

    masked = F.filter(F.transform("parts", loss), lambda s: s["target"])
    return parts.withColumn("lengths", lengths).select(
        F.col("conv").alias(conv_col),
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform(masked, lambda s: F.struct(s["start"], s["end"])).alias("loss"),
        F.size(F.filter("parts", lambda p: p["seen"])).alias("n_repeated"),
        "n_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted window."""
    pieces = F.split(formatted, r"<\|end\|>")
    halves = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def conversation_digest(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the windows of each conversation say, read back from their formatted text."""
    turns = read_turns(F.col("formatted"))
    fresh = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns) - F.col("n_repeated"), F.lit(0)))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    said = windows.select(
        F.col(conv_col),
        F.size(fresh).alias("n"),
        F.length("formatted").alias("chars"),
        F.struct(
            "window",
            F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join(learned, "").alias("learned"),
        ).alias("w"),
    )
    whole = said.groupBy(conv_col).agg(
        F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").cast("long").alias("formatted_chars")
    )
    joined = lambda name: F.array_join(F.transform("w", lambda w: w[name]), "")
    return whole.select(
        conv_col,
        "n_turns",
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("learned")).cast("long").alias("loss_chars"),
        F.sha2(joined("learned"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("w").alias("n_windows"),
    )
