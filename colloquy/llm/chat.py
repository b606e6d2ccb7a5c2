"""Chat formatting (operator 3), with Spark expressions only.

A conversation is collected as turn structs, sorted, runs of turns of a role are merged into blocks
(arrays of texts), and the blocks are concatenated; places of texts are running sums of lengths. Work
grows with a conversation's turns times their logarithm:

    <s>[system]text[/system]<s>[user]text[next]text[/user]<s>[assistant]text</s>

An assistant's block ends with ``</s>``, others with ``[/role]``; ``[next]`` stands between turns
that a block merges. In texts and roles ``&``, ``<`` and ``[`` are written as ``&amp;``, ``&lt;`` and
``&lsb;`` (in roles ``]`` as ``&rsb;`` too), so no text can hold a control string and the texts can be read back.

Defined results: a null text or role is empty; a null turn sorts first; rows of equal turn sort by
role, then text; repeated rows are turns of their own; a null conv_id is a conversation of its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsb;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lsb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("]"), F.lit("&rsb;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&rsb;"), F.lit("]")))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, formatted, loss_spans): loss_spans has begin (from 1) and length, in code points
    of ``formatted``, of each text of ``loss_role``."""
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    role = lambda i: F.get("t", i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))

    def block(starts: Column, start: Column, j: Column) -> Column:
        """A run of turns of one role."""
        own = F.slice("t", start + 1, F.coalesce(F.get(starts, j + 1), F.size("t")) - start)
        return F.struct(role(start).alias("role"), F.transform(own, lambda x: escaped(x["text"])).alias("texts"))

    blocks = whole.select("conv_id", held(starts, lambda s: F.transform(s, lambda start, j: block(s, start, j))).alias("b"))
    left = lambda b: F.concat(F.lit("<s>["), escaped_role(b["role"]), F.lit("]"))
    right = lambda b: F.when(b["role"] == loss_role, F.lit("</s>")).otherwise(F.concat(F.lit("[/"), escaped_role(b["role"]), F.lit("]")))
    formatted = F.array_join(F.transform("b", lambda b: F.concat(left(b), F.array_join(b["texts"], "[next]"), right(b))), "")

    def pieces(b: Column) -> Column:
        """Of each text of a block: what stands before it since the text before, and its own length."""
        end = F.size(b["texts"]) - 1
        before = lambda i: F.when(i == 0, F.length(left(b))).otherwise(F.length(F.lit("[next]"))).cast("long")
        after = lambda i: F.when(i == end, F.length(right(b))).otherwise(F.lit(0)).cast("long")
        return F.transform(b["texts"], lambda x, i: F.struct(before(i).alias("open"), F.length(x).cast("long").alias("body"), after(i).alias("close"), (b["role"] == loss_role).alias("loss")))

    placed = blocks.select("conv_id", formatted.alias("formatted"), F.flatten(F.transform("b", pieces)).alias("p"))
    ends = running_sums(F.transform("p", lambda p: p["open"] + p["body"] + p["close"]))
    spans = held(ends, lambda e: F.transform("p", lambda p, i: F.struct((F.get(e, i) - p["close"] - p["body"] + 1).alias("begin"), p["body"].alias("length"), p["loss"].alias("loss"))))
    kept = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["begin"].alias("begin"), s["length"].alias("length")))
    return placed.select("conv_id", "formatted", kept.alias("loss_spans"))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once. As a plain column Spark could move its expression into the
    lambda functions that use it, and compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """The sum of each entry and those before it, by doubling: as many passes as the logarithm of the entries."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(steps, values, lambda sums, step: F.transform(sums, lambda x, i: x + F.coalesce(F.when(i >= step, F.get(sums, i - step)), F.lit(0).cast("long"))))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, turns, loss_text) read back from what ``format_chats`` returns."""
    blocks = F.filter(F.split("formatted", "<s>", -1), lambda b: b != "")

    def of_block(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(2)), "]", 1)
        body = F.substr(b, F.length(role) + 3)
        close = F.when(body.endswith("</s>"), F.lit(4)).otherwise(F.length(role) + 3)
        inner = F.substr(body, F.lit(1), F.length(body) - close)
        return F.transform(F.split(inner, r"\[next\]", -1), lambda x: F.struct(unescaped_role(role).alias("role"), unescaped(x).alias("text")))

    # four bytes a code point, so that a place is reached without counting from the start
    text = lambda wide, s: F.decode(F.substr(wide, ((s["begin"] - 1) * 4 + 1).cast("int"), (s["length"] * 4).cast("int")), "UTF-32")
    loss = held(F.encode("formatted", "UTF-32"), lambda wide: F.array_join(F.transform("loss_spans", lambda s: unescaped(text(wide, s))), ""))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, of_block)).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    back = read_chats(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
