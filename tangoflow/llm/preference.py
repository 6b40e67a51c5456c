"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of a pair is rendered once, as the prompt; the
turns from the first difference on are the two completions, in which only
assistant turns carry loss.  The result has one row per rendered turn, in
which a training record is the rows of its pair in order: no conversation,
however long, is ever gathered into one task.  ``records`` gathers them where
records are known to fit.

The first difference is a minimum over aggregated turn fingerprints, so the
common prefix costs one partially aggregated shuffle of hashes, and texts move
once, to their pair; a pair that
holds a third of all turns is split by Spark's skew join.

Cases: null roles read "unknown", null texts are empty; a null turn comes
after all others; repeated rows (same conversation, turn, role and text) count
once, different rows of one turn are ordered by role, then text; a conversation without
partner (or with a null id) is a completion without prompt and ``paired`` is
false; identical conversations are all prompt; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def neighbours(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``turns`` with pair_id and side: of two neighbouring ids 2k and 2k + 1,
    the even one is chosen and the odd one rejected."""
    return turns.withColumns({"pair_id": F.shiftright(F.col(conv).cast("long"), 1),
                              "side": F.when(F.pmod(F.col(conv), F.lit(2)) == 1, "rejected").otherwise("chosen")})


def preference_turns(turns: DataFrame) -> DataFrame:
    """From (pair_id, side, turn, role, text): pair_id, part (prompt, chosen or
    rejected), turn, role, rendered, loss, paired."""
    c = F.col
    t = turns.select("pair_id", "side", F.coalesce(c("turn").cast("long"), F.lit(LAST)).alias("turn"),
                     F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("h", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    # the pair as two columns without nulls, so that the join and the drop of repeated rows share one partitioning
    kind = turns.schema["pair_id"].dataType
    t = t.withColumns({"k": F.coalesce("pair_id", F.lit(0).cast(kind)), "none": c("pair_id").isNull()})
    same = t.groupBy("k", "none", "turn", "h").agg(F.max(c("side") == "chosen").alias("l"), F.max(c("side") == "rejected").alias("r"))
    pairs = same.groupBy("k", "none").agg(
        F.min(F.when(~(c("l") & c("r")), c("turn"))).alias("first"), F.max("l").alias("l"), F.max("r").alias("r"))
    pairs = pairs.select("k", "none", "first", (c("l") & c("r") & ~c("none")).alias("paired"))
    j = t.join(pairs, ["k", "none"])
    common = c("first").isNull() | (c("turn") < c("first"))
    prompt = common & c("paired")
    # the prompt is rendered from the chosen side only; repeated rows are dropped where the join has put their pair
    j = j.where(~prompt | (c("side") == "chosen")).dropDuplicates(["k", "none", "side", "turn", "h"])
    part = F.when(prompt, "prompt").otherwise(c("side"))
    return j.select("pair_id", part.alias("part"), F.nullif("turn", F.lit(LAST)).alias("turn"), "role",
                    F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("rendered"),
                    (~prompt & (c("role") == "assistant")).alias("loss"), "paired")


def records(formatted: DataFrame) -> DataFrame:
    """One record per pair: prompt, chosen, rejected, and for the completions
    the [start, stop) character spans that carry loss.  Holds one record in
    memory at a time."""
    c = F.col
    order = F.struct(F.coalesce("turn", F.lit(LAST)).alias("turn"), "role", "rendered", "loss")
    per = formatted.groupBy("pair_id", "paired", "part").agg(F.sort_array(F.collect_list(order)).alias("t"))
    text = F.array_join(c("t.rendered"), "")
    spans = F.aggregate("t", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("s")),
                        lambda a, x: F.struct((a["at"] + F.length(x["rendered"])).alias("at"), F.when(x["loss"], F.concat(
                            a["s"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x["rendered"])).alias("stop")))))
                            .otherwise(a["s"]).alias("s")))["s"]
    per = per.select("pair_id", "paired", "part", text.alias("text"), spans.alias("loss"))
    one = lambda part, col: F.max(F.when(c("part") == part, c(col)))
    return per.groupBy("pair_id", "paired").agg(
        F.coalesce(one("prompt", "text"), F.lit("")).alias("prompt"), F.coalesce(one("chosen", "text"), F.lit("")).alias("chosen"),
        F.coalesce(one("rejected", "text"), F.lit("")).alias("rejected"), one("chosen", "loss").alias("chosen_loss"),
        one("rejected", "loss").alias("rejected_loss"))
