"""Chat formatting in budgeted windows, with DataFrame and SQL functions alone.

A conversation's turns are cut into windows of at most budget tokens, found from prefix sums of the turns' tokens. A window
holds whole turns: the leading system turn, a limited number of earlier turns as history, and new turns. Only new turns of
the assistant are under the loss mask, so every such text is a target exactly once.

Template: <|im_start|>ROLE newline TEXT<|im_end|> newline. In texts and roles "<|" becomes "<||", so no marker can occur in
them, and a newline in a role becomes "<|nl|>"; both can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What counts as a token: a run of letters, a digit, or a run of other signs; a turn's markers and role count as MARKERS.
TOKEN = "[\\p{L}\\p{M}]+|\\p{N}|[^\\s\\p{L}\\p{M}\\p{N}]+"
MARKERS = 5


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def windows(turns: DataFrame, budget: int = 1024, history_turns: int = 2, history_budget: int = 256, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens: str | None = None) -> DataFrame:
    """(conv, window, first_turn, last_turn, n_repeated, n_tokens, formatted, loss) for each window of each conversation.

    Turns are ordered by turn, role and text, nulls first; null roles and texts are empty. first_turn and last_turn number
    the new turns from 1; the first n_repeated turns of the window are the system turn and history and never targets. loss
    holds start and end (code points, end exclusive) of the escaped texts under the mask. A turn is never cut: a window
    goes over the budget only if one new turn with its system turn alone does: history gives way first. tokens names a
    column with the turns' own token counts (null: none), such as operator 1's; without it words and signs are counted. Null conversations are one
    conversation; repeated rows are turns of their own; an empty table gives no windows. Other columns are not looked at.
    """
    order = Window.partitionBy("c").orderBy("n", "r", "x")
    t = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"), (F.coalesce(F.col(tokens), F.lit(0)) if tokens else F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))).cast("long").alias("k"))
    t = t.withColumn("k", F.col("k") + MARKERS).withColumn("i", F.row_number().over(order))
    t = t.withColumn("q", F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    head = F.concat(F.lit(START), F.replace(escape(F.col("r")), F.lit("\n"), F.lit("<|nl|>")), F.lit("\n"))
    d = t.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "r", "q", head.alias("head"), escape(F.col("x")).alias("body")))).alias("t"))
    # A lambda over an array of one value names the value, so that it is worked out once a row: t are the turns, u their
    # number and whether the first is the system's. before(i) is the prefix sum of all turns before the i-th.
    before = lambda i: f"(CASE WHEN {i} <= 1 THEN 0L ELSE t[{i} - 2].q END)"
    history = f"element_at(filter(sequence(least(greatest(i - {history_turns}, u.sys + 1), i), i), j -> j = i OR {before('i')} - {before('j')} <= {history_budget} AND t[i - 1].q - {before('j')} + {before('(u.sys + 1)')} <= {budget}), 1)"
    spans = f"""aggregate(sequence(1, u.n), named_struct('now', named_struct('h', 1, 'f', 1, 'l', 1), 'out', cast(array() AS array<struct<h:int,f:int,l:int>>)), (a, i) ->
        CASE WHEN i = 1 THEN a
             WHEN t[i - 1].q - {before("a.now.h")} + CASE WHEN a.now.h > u.sys THEN {before("(u.sys + 1)")} ELSE 0L END <= {budget}
             THEN named_struct('now', named_struct('h', a.now.h, 'f', a.now.f, 'l', i), 'out', a.out)
             ELSE named_struct('now', named_struct('h', {history}, 'f', i, 'l', i), 'out', concat(a.out, array(a.now))) END,
        a -> concat(a.out, array(a.now)))"""
    shape = f"""named_struct('f', b.f, 'l', b.l, 'n_repeated', CASE WHEN b.h > u.sys THEN u.sys ELSE 0 END + b.f - b.h,
        'n_tokens', t[b.l - 1].q - {before("b.h")} + CASE WHEN b.h > u.sys THEN {before("(u.sys + 1)")} ELSE 0L END,
        'all', concat(slice(t, 1, CASE WHEN b.h > u.sys THEN u.sys ELSE 0 END), slice(t, b.h, b.l - b.h + 1)))"""
    cut = F.expr(f"""transform(array(t), t -> transform(array(named_struct('n', size(t), 'sys', CASE WHEN t[0].r = 'system' THEN 1 ELSE 0 END)),
        u -> transform({spans}, b -> {shape}))[0])[0]""")
    d = d.select("c", F.posexplode(cut).alias("window", "b")).select("c", "window", "b.*")
    formatted = F.expr(f"array_join(transform(all, x -> concat(x.head, x.body, '{END}\\n')), '')")
    loss = F.expr(f"""aggregate(all, named_struct('i', 0, 'at', 0, 'out', cast(array() AS array<struct<start:int,end:int>>)), (a, x) -> named_struct(
        'i', a.i + 1,
        'at', a.at + length(x.head) + length(x.body) + {len(END) + 1},
        'out', CASE WHEN a.i >= n_repeated AND x.r = 'assistant'
               THEN concat(a.out, array(named_struct('start', a.at + length(x.head), 'end', a.at + length(x.head) + length(x.body)))) ELSE a.out END), a -> a.out)""")
    return d.select(F.col("c").alias(conv), "window", F.col("f").alias("first_turn"), F.col("l").alias("last_turn"), "n_repeated", "n_tokens", formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns, loss_text, formatted_chars) from the rows of windows: the turns as role, newline, text, newline.

    Everything is taken out of the formatted strings: turns by the template's markers, targets by the mask.
    """
    d = formatted.withColumn("parts", F.split("formatted", "<\\|im_end\\|>\\n"))
    new = F.slice("parts", F.col("n_repeated") + 1, F.size("parts") - 1 - F.col("n_repeated"))
    body = lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x))
    split = F.transform(new, lambda x: F.struct(F.substring_index(body(x), "\n", 1).alias("r"), body(x).alias("x")))
    text = F.transform(split, lambda s: F.concat(unescape(F.replace(s["r"], F.lit("<|nl|>"), F.lit("\n"))), F.lit("\n"), unescape(F.substring(s["x"], F.length(s["r"]) + 2, F.length(s["x"]))), F.lit("\n")))
    lost = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    d = d.select(F.col(conv).alias("c"), F.struct("window", F.array_join(text, "").alias("t"), F.size(new).alias("n"), F.array_join(lost, "").alias("l"), F.length("formatted").alias("k")).alias("w"))
    d = d.groupBy("c").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda f: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[f])
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return d.select(F.col("c").alias(conv), total("n").alias("n_turns"), joined("t").alias("turns"), joined("l").alias("loss_text"), total("k").alias("formatted_chars"))
