"""Operator 7, chat formatting [native]: a grammar round trip.

A conversation is rendered turn by turn as

    ### role: text
    </turn>

and read back by a deterministic parser: cut at the unescaped `</turn>` lines, take the role up to the first `: `, drop
one backslash before every control string. A turn is first rendered as it is; whatever the parser does not give back
exactly (its text holds a control string, escaped or not) is rendered again with a backslash before each control
string, and compared once more. Control strings hold no backslash and do not overlap, so one more backslash always
makes the turn identical; a turn that still differs would end the query with an error.

The loss mask is a list of spans of the formatted text, one for the text of each turn of the LEARNED roles: where the
rendered turns begin is a running sum of their lengths, in code points and in bytes. `under_mask` cuts the formatted
text by it (by bytes, which takes no search) and takes the escapes out.

Defined cases: null text and null role are empty; turns are ordered by (turn, role, text), null first, and repeated
rows, which tie, are turns of their own; rows with a null conv_id make one conversation; very long texts are rendered
and cut in time linear in them; an empty table gives an empty result; other columns are ignored. A conversation is one
row by contract, so it must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from babelmill.llm.common import table

OPEN, CLOSE = "### ", "\n</turn>\n"
CONTROL = r"(### [A-Za-z]+: |</turn>)"
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def role_escaped(role: Column) -> Column:
    """Roles stand on one line and end at the first `: `."""
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def role_unescaped(role: Column) -> Column:
    kept = F.replace(role, F.lit("\\\\"), F.lit("\\s"))  # s: a backslash; told apart from \c and \n
    return F.replace(F.replace(F.replace(kept, F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def rendered(role: Column, body: Column) -> Column:
    return F.concat(head(role), body, F.lit(CLOSE))


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role_escaped(role), F.lit(": "))


def under_mask(formatted: Column, mask: Column) -> Column:
    """array<string>: the texts under the loss mask, unescaped, cut out of the formatted text."""
    held = F.struct(formatted.cast("binary").alias("bytes"), mask.alias("mask"))
    cut = lambda x, m: F.substring(x["bytes"], m["first_byte"] + 1, m["n_bytes"]).cast("string")
    # An array of one, so that the bytes are worked out once.
    return F.transform(F.array(held), lambda x: F.transform(x["mask"], lambda m: unescaped(cut(x, m))))[0]


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, r"\n</turn>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        colon = F.position(F.lit(": "), p)
        role = F.substring(p, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)
        return F.struct(role_unescaped(role).alias("role"), unescaped(F.substring(p, colon + 2, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (as read back), loss_mask: the rendered conversation, its proof, and the spans
    struct<start, length, first_byte, n_bytes> of what is learned, in code points and in bytes from 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    same = (F.size("_back") == 1) & (F.col("_back")[0]["text"] == F.col("text")) & (F.col("_back")[0]["role"] == F.col("role"))
    turns = turns.withColumn("_back", parsed(rendered(F.col("role"), F.col("text")))).withColumn(
        "_body", F.when(same, F.col("text")).otherwise(escaped(F.col("text")))
    )
    before = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    whole = rendered(F.col("role"), F.col("_body"))
    turns = turns.withColumns({
        "_start": F.coalesce(F.sum(F.char_length(whole)).over(before), F.lit(0)).cast("int"),
        "_first": F.coalesce(F.sum(F.octet_length(whole)).over(before), F.lit(0)).cast("int"),
    })
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "_start", "_first", "_body"))).alias("_t"))
    mask = F.transform(F.filter("_t", lambda t: t["role"].isin(*LEARNED)), lambda t: F.struct(
        (t["_start"] + F.char_length(head(t["role"]))).alias("start"), F.char_length(t["_body"]).alias("length"),
        (t["_first"] + F.octet_length(head(t["role"]))).alias("first_byte"), F.octet_length(t["_body"]).alias("n_bytes"),
    ))
    formatted = F.array_join(F.transform("_t", lambda t: rendered(t["role"], t["_body"])), "")
    convs = convs.withColumn("formatted", formatted).withColumn("turns", parsed(F.col("formatted")))
    source = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    proof = F.when(F.col("turns") == source, F.col("turns")).otherwise(
        F.raise_error(F.lit("a conversation was not read back as it was written")).cast("array<struct<role:string,text:string>>")
    )
    return convs.select("conv_id", "formatted", proof.alias("turns"), mask.alias("loss_mask"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    f = format_conversations(conversations.unionByName(extra))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(under_mask(F.col("formatted"), F.col("loss_mask")), "")
    f = f.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        masked.alias("_masked"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return f.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("_masked").cast("long").alias("loss_chars"),
        F.sha2("_masked", 256).alias("loss_sha256"), "formatted_chars",
    )
