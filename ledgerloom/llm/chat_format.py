r"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example's text is the formatted turns up to and with its reply; only the reply's text is under the loss mask, given as a
span of code points. A conversation that ends in another turn also gives one example without a loss span, so the output
holds every turn. A turn is "### role: text</turn>\n". Inside texts and roles the escapes \b, \h, \l (and \c in roles) stand
for a backslash, the "#" of "### ", the "<" of "</turn>" and a colon, so control strings occur only as control strings and
every text can be read back exactly.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text), nulls first, so repeated turn
numbers have a fixed order and repeated rows are turns like any others; rows with a null conv_id form one conversation.
An empty table gives no examples. A conversation's examples are made by one sorted window: its turns stream through a task,
and no more than one example is in memory. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import _shared as sh

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = [("\\", "\\b"), ("### ", "\\h## "), ("</turn>", "\\l/turn>")]


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in [*ESCAPES, *([(":", "\\c")] if role else [])]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for code, plain in [*([("\\c", ":")] if role else []), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start and loss_chars (null without a target), and whether it is the conversation's last."""
    turns = sh.typed(conversations, conv_id="long", turn="long", role="string", text="string")
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    formatted = F.concat(F.lit(OPEN), escaped(role, True), F.lit(BETWEEN), text, F.lit(CLOSE))
    turns = turns.select("conv_id", "turn", "role", "text", formatted.alias("formatted"), F.length(text).cast("long").alias("loss_chars"), (role == "assistant").alias("target"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_place = turns.withColumns({"last": F.lead(F.lit(False), 1, True).over(order), "so_far": F.collect_list("formatted").over(before), "example": F.sum(F.col("target").cast("long")).over(before)})
    chosen = with_place.where("target or last").withColumn("joined", F.array_join("so_far", ""))
    start = F.length("joined") - len(CLOSE) - F.col("loss_chars")
    target = F.col("target")
    return chosen.select(
        "conv_id",
        (F.col("example") - target.cast("long")).alias("example"),
        F.col("joined").alias("text"),
        F.when(target, start).alias("loss_start"),
        F.when(target, F.col("loss_chars")).alias("loss_chars"),
        "last",
    )


def turns_of(text: Column) -> Column:
    """The (role, text) structs that an example's text holds."""
    parts = F.split(text, CLOSE, -1)
    own = F.slice(parts, 1, F.size(parts) - 1)
    split = lambda x: F.struct(
        unescaped(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), BETWEEN, 1), True).alias("role"),
        unescaped(F.substr(x, F.instr(x, BETWEEN) + len(BETWEEN))).alias("text"),
    )
    return F.transform(own, split)


def loss_text(text: Column, start: Column, chars: Column) -> Column:
    return unescaped(F.substr(text, (start + 1).cast("int"), chars.cast("int")))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from examples(): a row for each conversation."""
    all_turns = F.array_join(F.transform(turns_of(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"),
        F.when(F.col("last"), F.struct((F.size(F.split("text", CLOSE, -1)) - 1).cast("long").alias("n"), F.sha2(all_turns, 256).alias("sha"))).alias("turns"),
        loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    own = read.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.max("turns").alias("turns"), F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return own.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
