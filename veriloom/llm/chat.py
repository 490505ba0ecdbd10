"""Chat formatting by perspective rotation [DataFrame functions only].

Every participant of a dialogue gets a rendering of it: the participant's turns are the
assistant's, all others are users' under their names, and the mask covers what the assistant says.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .tables import cut, running_total

OPEN, CLOSE = "<|", "|>"
#: Participants of this name set the scene; they are rendered as they are and get no rendering.
SCENE = "system"


def _safe(x: Column) -> Column:
    """Text in which no header can stand: the opening mark is taken apart."""
    return F.regexp_replace(x, r"<\|", "< |")


def _head(speaker: Column, perspective: Column) -> Column:
    """The header of a message, as the perspective's participant sees its speaker."""
    name = F.concat(F.lit("user name="), F.regexp_replace(speaker, r"[^\p{L}\p{N}_-]", "_"))
    return F.concat(F.lit(OPEN), F.when(speaker == perspective, "assistant").when(speaker == SCENE, SCENE).otherwise(name), F.lit(CLOSE + "\n"))


def rotate(messages: DataFrame, messages_a_part: int = 64) -> DataFrame:
    """Renderings of ``messages`` (conv_id, turn, role, text): conv_id, perspective, part, begin,
    text, n_turns and ``mask``, an array of (begin, end) in characters, end exclusive, of what the
    perspective's participant says.

    A participant is a role of the dialogue. Messages come in the order of turn (null first), role
    and text and are numbered through the dialogue; a row holds ``messages_a_part`` of them, so that
    no task gathers a dialogue of any length. The rows of a perspective joined in the order of
    ``part`` are its whole rendering: ``begin`` is where a row's text begins in it, and masks are
    places in it too. Messages that repeat in all four columns are one message, but without a turn
    each is one of its own. A null role is the participant "unknown", a null text is empty, a null
    conv_id is a dialogue of its own. Dialogues of only the scene's messages have no rendering.
    """
    said = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said"))
    said = said.groupBy("conv_id", "turn", "speaker", "said").agg(F.count("*").alias("times")).withColumn("times", F.when(F.col("turn").isNull(), F.col("times")).otherwise(F.lit(1)))
    counted = running_total(said.withColumn("lead", F.left("said", F.lit(32))), ["conv_id"], ["turn", "speaker", "lead", "said"], "times", "before", n_dealt=3)
    numbered = counted.select("conv_id", "speaker", "said", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("times") - 1)).alias("number"))
    part = F.floor(F.col("number") / messages_a_part).cast("long").alias("part")
    parts = cut(numbered.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("number", "speaker", "said"))).alias("turns")))
    speakers = parts.select("conv_id", F.explode(F.array_distinct(F.transform("turns", lambda t: t["speaker"]))).alias("perspective"))
    people = speakers.where(F.col("perspective") != SCENE).distinct().withColumnRenamed("conv_id", "of")
    sizes = parts.select("conv_id", "part", F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), F.length(_safe(t["said"])).alias("size"))).alias("sizes"))
    lengths = sizes.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    length = F.aggregate("sizes", F.lit(0), lambda n, t: n + F.length(_head(t["speaker"], F.col("perspective"))) + t["size"] + 1)
    begins = running_total(lengths.select("conv_id", "perspective", "part", length.alias("length")), ["conv_id", "perspective"], ["part"], "length", "begin")
    begins = begins.select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), "perspective", "begin")
    met = parts.join(begins, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).drop("of", "of_part")
    mine = lambda t: t["speaker"] == F.col("perspective")
    pieces = F.transform("turns", lambda t: F.struct(mine(t).alias("mine"), _head(t["speaker"], F.col("perspective")).alias("head"), _safe(t["said"]).alias("said")))
    out = met.select("conv_id", "perspective", "part", "begin", pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["said"], F.lit("\n"))), "")
    start = F.struct(F.col("begin").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("mask"))

    def step(done: Column, p: Column) -> Column:
        begin = done["at"] + F.length(p["head"])
        end = begin + F.length(p["said"])
        mask = F.when(p["mine"], F.concat(done["mask"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(done["mask"])
        return F.struct((end + 1).alias("at"), mask.alias("mask"))

    return out.select("conv_id", "perspective", "part", "begin", text.alias("text"), F.size("pieces").alias("n_turns"), F.aggregate("pieces", start, step, lambda d: d["mask"]).alias("mask"))
