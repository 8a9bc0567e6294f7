"""Chat formatting into budgeted windows, in DataFrame functions only.

Turns carry prefix sums of their tokens. Walking a conversation, a window takes turns as
targets until its budget would be passed; the next one starts at that turn, after the
system turn (if the conversation starts with one) and as much of the preceding turns as
`history` tokens allow, both repeated and masked. Spans are aligned to turns: a single
turn over the budget gets a window of its own, whole.

The template marks a turn as <turn>role NEWLINE text</turn> NEWLINE. In texts and roles
& and < are written as &amp; and &lt;, and a new line in a role as &nl;, so no text can
hold a mark and every text comes back exactly. The loss mask is an array of (start,
length) spans of code points over a window's formatted text: each assistant text once,
in the window where it is a target.

Defined cases: a null text or role is empty. Turns go by turn, then role and text (nulls
first); repeated rows are turns of their own. A null conversation id is a conversation.
An empty table gives no windows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.llm.common import word_count

OPEN, CLOSE = "<turn>", "</turn>\n"
OVERHEAD = 4  # tokens of a turn's marks and role


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def windows(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """Rows (conv_id, window, n_context, n_targets, tokens, text, loss): n_context turns
    are repeated at the start of text, n_targets are new."""
    if not 0 <= history < budget:
        raise ValueError("history must be less than budget")
    blank = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("tok", word_count(F.col("text")) + OVERHEAD).withColumn("pos", F.row_number().over(order) - 1)
    by_pos = W.partitionBy("conv_id").orderBy("pos")
    rows = rows.withColumn("start", F.sum("tok").over(by_pos) - F.col("tok"))
    rows = rows.withColumn("system", F.first(F.when((F.col("pos") == 0) & (F.col("role") == "system"), F.col("tok"))).over(by_pos))
    rows = rows.withColumn("system", F.coalesce("system", F.lit(0)))
    # Where history would start if a window started at this turn: the first turn after the
    # system turn that is at most `history` tokens back.
    back = F.min(F.when(F.col("start") >= F.col("system"), F.struct("start", "pos"))).over(W.partitionBy("conv_id").orderBy("start").rangeBetween(-history, 0))
    rows = rows.withColumn("from", F.coalesce(back, F.struct("start", "pos")))
    escaped_role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&nl;"))
    body = F.concat(F.lit(OPEN), escaped_role, F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    turn = F.struct("pos", "start", "tok", F.col("from.start").alias("from_start"), F.col("from.pos").alias("from_pos"), body.alias("body"), (F.col("role") == "assistant").alias("assistant"), (F.length(escaped_role) + len(OPEN) + 1).alias("lead"), F.length(escape(F.col("text"))).alias("size"))
    whole = rows.groupBy("conv_id").agg(F.max("system").alias("system"), F.array_sort(F.collect_list(turn)).alias("turns"))

    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("history"))

    def walk(acc: Column, t: Column) -> Column:
        end = t["start"] + t["tok"]
        used = F.col("system") + acc["history"] + end - acc["base"]
        first = F.size(acc["starts"]) == 0
        own = (F.col("system") > 0) & (t["pos"] == 0)
        fresh = F.struct(F.array_append(acc["starts"], t["pos"]).alias("starts"), t["start"].alias("base"), F.when(first, 0).otherwise(t["start"] - t["from_start"]).cast("bigint").alias("history"))
        return F.when(own, acc).when(first | (used > budget), fresh).otherwise(acc)

    starts = F.aggregate("turns", zero, walk)["starts"]
    # A conversation of a system turn alone has one window, without targets after it.
    starts = F.when(F.size(starts) == 0, F.array(F.lit(1))).otherwise(starts)
    placed = whole.withColumn("starts", starts).select("conv_id", "system", "turns", "starts", F.posexplode("starts").alias("window", "first"))
    has_system = (F.col("system") > 0).cast("int")
    till = F.coalesce(F.get("starts", F.col("window") + 1), F.size("turns"))
    since = F.when(F.col("window") == 0, F.col("first")).otherwise(F.get("turns", F.col("first"))["from_pos"])
    cut = placed.select(
        "conv_id",
        "window",
        F.when(F.col("window") == 0, 0).otherwise(has_system + F.col("first") - since).alias("n_context"),
        F.concat(F.slice("turns", 1, has_system), F.slice("turns", since + 1, till - since)).alias("turns"),
    )
    at = F.transform(F.sequence(F.lit(0), F.size("turns")), lambda i: F.aggregate(F.slice("turns", 1, i), F.lit(0), lambda a, t: a + F.length(t["body"])))
    spans = F.zip_with("turns", F.slice("at", 1, F.size("turns")), lambda t, a: F.struct((a + t["lead"]).alias("start"), t["size"].alias("length"), t["assistant"].alias("on")))
    new = F.slice("spans", F.col("n_context") + 1, F.size("spans"))
    cut = cut.withColumn("at", at).withColumn("spans", spans)
    return cut.select(
        "conv_id",
        "window",
        "n_context",
        (F.size("turns") - F.col("n_context")).alias("n_targets"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + t["tok"]).alias("tokens"),
        F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("text"),
        F.transform(F.filter(new, lambda s: s["on"]), lambda s: F.struct(s["start"], s["length"])).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from windows' text and loss mask alone: turns (array of
    role, text), loss_text and formatted_chars. Repeated turns are passed over."""
    pieces = F.split(F.col("text"), CLOSE, -1)
    new = F.slice(pieces, F.col("n_context") + 1, F.col("n_targets"))

    def parse(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substr(piece, F.length(role) + 2)
        role = unescape(F.replace(F.substr(role, F.lit(len(OPEN) + 1)), F.lit("&nl;"), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"]))), "")
    parts = formatted.select("conv_id", F.struct("window", F.transform(new, parse).alias("turns"), loss.alias("loss"), F.length("text").alias("chars")).alias("w"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("w", lambda w: w["loss"]), "").alias("loss_text"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
    )
