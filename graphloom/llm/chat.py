"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns become one or more training samples. A fold over the prefix sums of
the turns' token costs chooses spans of whole turns, each as long as the budget allows; a window holds
the system turn, the turns just before its span as far as the history budget and what the span leaves
go, and the span itself. The loss mask covers the texts of new assistant turns only, so that a
repeated turn is never a target again.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts and roles
``<``, any backslashes, ``|`` gets one backslash more, so that no control string can
stand in them; reading takes it away again. Roles also write a line feed as ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
CHARS_PER_TOKEN = 4


def escape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


#: Window starts that the fold of a conversation holds in one array before it puts them aside.
FOLD = 1024


def _window_starts(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, before): prefix sums at which windows after the first begin, of turns (conv_id, before, cost, kept).

    One fold over a conversation's prefix sums, greedily: a turn goes into the window while the window's new turns,
    the system turn and, from the second window on, a full history keep the budget.
    """
    state = F.struct(F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("reserve"), F.array().cast("array<long>").alias("starts"), F.array().cast("array<array<long>>").alias("aside"))

    def step(acc: Column, turn: Column) -> Column:
        full = F.size(acc["starts"]) == FOLD
        begun = F.struct(
            turn["before"].alias("begin"),
            F.lit(history).cast("long").alias("reserve"),
            F.when(full, F.array(turn["before"])).otherwise(F.array_append(acc["starts"], turn["before"])).alias("starts"),
            F.when(full, F.array_append(acc["aside"], acc["starts"])).otherwise(acc["aside"]).alias("aside"),
        )
        over = (turn["before"] > acc["begin"]) & (turn["before"] + turn["cost"] - acc["begin"] > budget - turn["kept"] - acc["reserve"])
        return F.when(over, begun).otherwise(acc)

    folded = F.aggregate(F.sort_array(F.collect_list(F.struct("before", "cost", "kept"))), state, step, lambda acc: F.flatten(F.array_append(acc["aside"], acc["starts"])))
    return turns.groupBy("conv_id").agg(folded.alias("starts")).select("conv_id", F.explode("starts").alias("before"))


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Samples of all turns (conv_id, turn, role, text): conv_id, window, text, loss (array of start, length in code points), n_repeated.

    budget: tokens of a window (a token is CHARS_PER_TOKEN code points of the formatted
    turn, rounded up); history: those of repeated turns at most, fewer where the new ones leave less. A turn is never split: one that is longer
    than the budget beside the system turn is the only other turn of its window, and a system turn is kept whatever its length; all other windows keep the budget.
    The system turn is a first turn of role system. Null texts and roles are empty; turns
    of equal number are ordered by role and text, repeated rows all stay; a null conv_id
    is a conversation of its own. Other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    ordered = conv.orderBy("turn", "role", "text")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = (
        rows.withColumn("at", F.row_number().over(ordered))
        .withColumn("body", escape(F.col("text")))
        .withColumn("head", head)
        .select("conv_id", "at", "role", "head", "body")
        .withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
        .withColumn("chars", F.length("head") + F.length("body") + len(END) + 1)
        .withColumn("cost", F.ceil(F.col("chars") / CHARS_PER_TOKEN))
    )
    run = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    new_cost = F.when(~F.col("system"), F.col("cost"))
    rows = rows.withColumn("before", F.coalesce(F.sum(new_cost).over(run), F.lit(0))).withColumn("kept", F.coalesce(F.max(F.when(F.col("system"), F.col("cost"))).over(conv), F.lit(0)))
    # a window's start stands before the turn of the same prefix sum, and counts the windows
    starts = _window_starts(rows.filter(~F.col("system")).select("conv_id", "before", "cost", "kept"), budget, history).withColumn("starts", F.lit(1))
    rows = rows.withColumn("starts", F.lit(0)).unionByName(starts, allowMissingColumns=True)
    up_to = Window.partitionBy("conv_id").orderBy("before", F.desc("starts"), "at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("starts").over(up_to)).filter("starts = 0")
    # a window's history: the turns that reach back from its first new one as far as the budget goes
    spent = F.sum(new_cost).over(Window.partitionBy("conv_id", "own"))
    rows = rows.withColumn("room", F.least(F.lit(history), F.greatest(F.lit(0), budget - F.col("kept") - spent)))
    opens = ~F.col("system") & (F.coalesce(F.lag("own").over(conv.orderBy("at")), F.lit(0)) < F.col("own"))
    rows = rows.withColumn("opens", F.when(opens, F.struct("own", (F.col("before") - F.col("room")).alias("back")))).withColumn("last", F.max("own").over(conv))
    ahead = F.collect_list("opens").over(conv.orderBy("before").rangeBetween(1, history))  # of starts so near there are few
    again = F.transform(F.filter(ahead, lambda w: w["back"] <= F.col("before")), lambda w: w["own"])
    rows = rows.withColumn("again", again)
    into = F.when(F.col("system"), F.sequence(F.lit(0).cast("long"), F.col("last"))).otherwise(F.concat(F.array("own"), "again"))
    rows = rows.select("conv_id", "at", "role", "head", "body", "system", "chars", "own", F.explode(into).alias("window"))
    rows = rows.withColumn("new", F.col("window") == F.col("own"))
    before = Window.partitionBy("conv_id", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.length("head"))
    target = F.when(F.col("new") & (F.col("role") == "assistant"), F.length("body"))
    parts = rows.select("conv_id", "window", F.struct("at", F.concat("head", "body", F.lit(END + "\n")).alias("segment"), "new", F.col("start").cast("long").alias("start"), target.cast("long").alias("target")).alias("part"))
    samples = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return samples.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"),
        F.transform(F.filter("parts", lambda p: p["target"].isNotNull()), lambda p: F.struct(p["start"].alias("start"), p["target"].alias("length"))).alias("loss"),
        F.size(F.filter("parts", lambda p: ~p["new"])).cast("long").alias("n_repeated"),
    )


def parse_samples(samples: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text, of the new turns), targets (array of unescaped texts under the loss mask), chars: all read from the formatted text."""
    pieces = F.split("text", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing follows the last end mark
    pieces = F.filter(pieces, lambda p, i: i >= F.col("n_repeated"))
    bodies = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    role = lambda b: F.substring_index(b, "\n", 1)
    turns = F.transform(bodies, lambda b: F.struct(unescape_role(role(b)).alias("role"), unescape(F.substring(b, F.length(role(b)) + 2, F.length(b))).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return samples.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("text").cast("long").alias("chars"))


def digest(samples: DataFrame) -> DataFrame:
    """Per conversation, read back from its samples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parsed = parse_samples(samples).select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join("targets", "").alias("target"),
            F.size("turns").cast("long").alias("n"),
            "chars",
        ).alias("part"),
    )
    whole = parsed.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("part.n").alias("n_turns"), F.sum("part.chars").alias("formatted_chars"))
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    target = F.array_join(F.transform("parts", lambda p: p["target"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars")
