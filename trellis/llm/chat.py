"""Chat formatting in budgeted windows. DataFrame and SQL functions only.

A conversation's turns get prefix sums of their tokens; the sums deal the turns into spans of whole turns within
the budget. Each window after the first repeats the leading system turn and the last turns of the span before it, as
far as HISTORY tokens go. Loss covers the text of assistant turns, in the window where they are new only.

The template is  <|turn|>role<|text|>text<|end|>\\n  with, inside role and text, a backslash before every backslash
and between the two characters of every <| . So no control string can occur in a text, and removing one backslash
before each character restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
BUDGET, HISTORY = 1024, 128
#: Tokens counted for a turn besides its words, numbers and signs: the three marks.
MARKS = 3


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: words, numbers and other signs one by one, and the marks."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")).cast("bigint") + MARKS


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, n_tokens, n_repeated and loss (start and length in code points of each masked-in text).

    Turns are ordered by turn, role and text, nulls first; null roles and texts are empty. A system turn counts as
    leading only if it is the first. The new turns of a window keep within budget - system turn - history tokens (at
    least a quarter of the budget) unless one turn alone is longer; no turn is cut. Repeated rows are turns of
    their own. Rows with a null conv_id are one conversation. An empty table gives no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)).alias("head"),
        escaped(F.col("text")).alias("body"),
        turn_tokens(F.col("text")).alias("tokens"),
    )
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = turns.select(
        *[c for c in turns.columns if c not in ("text",)],
        F.row_number().over(order).alias("pos"),
        F.sum("tokens").over(upto).alias("prefix"),
        F.first(F.when(F.col("role") == "system", F.col("tokens")).otherwise(0)).over(upto).alias("system"),
    )
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    stride = F.greatest(budget - F.col("system") - history, F.lit(budget // 4))
    start = F.when(system, F.lit(0)).otherwise(F.col("prefix") - F.col("tokens") - F.col("system"))
    last = F.when(system, F.lit(0)).otherwise(F.col("prefix") - F.col("system") - 1)
    dealt = summed.withColumns({"is_system": system, "stride": stride, "bucket": F.floor(start / stride), "over": F.floor(last / stride) > F.floor(start / stride)})
    # A turn across the end of its bucket joins the bucket's other turns if all of them fit, and is a span of its own if not.
    own = Window.partitionBy("conv_id", "bucket")
    fits = F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(own) <= F.col("stride")
    joined = dealt.withColumn("alone", F.col("over") & ~fits)
    order = conv.orderBy("pos")
    change = (F.coalesce(F.lag("bucket").over(order) != F.col("bucket"), F.lit(False))) | (F.col("alone") & (F.col("pos") > 1))
    spans = joined.withColumn("_change", change.cast("bigint")).withColumn("span", F.sum("_change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = spans.withColumns({"_end": F.max("prefix").over(Window.partitionBy("conv_id", "span")), "_last": F.max("span").over(conv)})
    place = lambda w, again: F.struct(w.alias("window"), F.lit(again).alias("again"))
    own_place = F.array(place(F.col("span"), False))
    recalled = (F.col("_end") - F.col("prefix") + F.col("tokens") <= history) & (F.col("span") < F.col("_last"))
    places = (
        F.when(F.col("is_system") & (F.col("_last") > 0), F.concat(own_place, F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("_last")), lambda w: place(w, True))))
        .when(recalled & ~F.col("is_system"), F.concat(own_place, F.array(place(F.col("span") + 1, True))))
        .otherwise(own_place)
    )
    held = ends.select("conv_id", "pos", "role", "head", "body", "tokens", F.explode(places).alias("p")).select("conv_id", "p.window", "p.again", "pos", "role", "head", "body", "tokens")
    within = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("head") + F.length("body") + len(END)
    marked = held.withColumn("_from", F.sum(size).over(within) - F.length("body") - len(END))
    piece = F.struct("pos", F.concat("head", "body", F.lit(END)).alias("text"), F.struct(F.col("_from").alias("start"), F.length("body").alias("length")).alias("span"), ((F.col("role") == "assistant") & ~F.col("again")).alias("loss"))
    grouped = marked.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("_t"), F.sum("tokens").alias("n_tokens"), F.sum(F.col("again").cast("bigint")).alias("n_repeated"))
    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("_t", lambda t: t["text"]), "").alias("text"),
        "n_tokens",
        "n_repeated",
        F.transform(F.filter("_t", lambda t: t["loss"]), lambda t: t["span"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, new turns (role and text) and loss texts, parsed from the formatted text alone."""
    parts = F.split(F.col("text"), r"<\|end\|>\n", -1)
    turn = lambda t: F.split(F.substr(t, F.lit(len(TURN) + 1)), r"<\|text\|>", 2)
    new = F.slice(parts, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(parts) - 1 - F.col("n_repeated").cast("int"), F.lit(0)))
    return formatted.select(
        "conv_id",
        "window",
        F.transform(new, lambda t: F.struct(unescaped(turn(t)[0]).alias("role"), unescaped(turn(t)[1]).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substr("text", s["start"].cast("int") + 1, s["length"]))).alias("losses"),
        F.length("text").cast("bigint").alias("chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the windows."""
    back = read_back(formatted)
    line = back.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("losses", "").alias("loss"),
        ).alias("w"),
        F.size("turns").cast("bigint").alias("n"),
        "chars",
    )
    whole = line.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = whole.select("conv_id", "n_turns", "formatted_chars", F.array_join(F.col("w.turns"), "").alias("turns"), F.array_join(F.col("w.loss"), "").alias("loss"))
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
