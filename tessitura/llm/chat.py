"""Chat formatting with Spark expressions only: sort, merge, escape, concatenate, and read back.

A block opens with ``<|turn|>role`` and a newline and closes with ``<|end|>`` and a newline. Adjacent turns of one role
share a block, parted by ``<|next|>``. Inside roles and texts ``&`` becomes ``&amp;`` and ``<`` becomes ``&lt;`` (and a
newline in a role ``&#10;``), so no text can hold a control string and reading back restores every turn as it was.
``loss_spans`` are the code point ranges of the assistant's texts in the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import table

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>\n"
#: Turns whose spans are found together.
RUN = 256
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation of (conv_id, turn, role, text).

    Null roles and texts are empty; turns sort by number (null first), then role, then text, so repeated rows are
    turns of their own. A null conv_id is a conversation like any other. Empty input gives no rows.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    last = F.size("t") - 1

    def piece(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get("t", i - 1)["role"] != t["role"])
        closes = (i == last) | (F.get("t", i + 1)["role"] != t["role"])
        head = F.concat(F.lit(TURN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
        return F.struct(
            F.when(opens, head).otherwise(NEXT).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise("").alias("tail"),
            (t["role"] == loss_role).alias("loss"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("t", piece).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + F.char_length(p["tail"])).alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    # appending copies what is there, so spans are found run by run, from 0, and then moved by the length before their run
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("p") / RUN).cast("int") - 1, F.lit(0))), lambda i: F.slice("p", i * RUN + 1, RUN))
    text = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    local = pieces.select("conv_id", text.alias("formatted"), F.transform(runs, lambda r: F.aggregate(r, start, walk)).alias("runs"))
    before = F.aggregate("runs", F.array(F.lit(0).cast("long")), lambda acc, r: F.array_append(acc, F.element_at(acc, -1) + r["at"]))

    def moved(run: Column, offset: Column) -> Column:
        return F.transform(run["spans"], lambda s: F.struct((s["start"] + offset).alias("start"), (s["end"] + offset).alias("end")))

    spans = F.flatten(F.zip_with("runs", F.slice(before, F.lit(1), F.size("runs")), moved))
    return local.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): the turns and the text under the loss mask, read from the output alone."""
    blocks = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|turn\|>")) - 1, F.lit(0)))

    def turns_of(block: Column) -> Column:
        role = unescape(F.replace(F.substring_index(block, "\n", 1), F.lit("&#10;"), F.lit("\n")))
        inner = F.substring(block, F.instr(block, "\n") + 1, F.char_length(block) - F.instr(block, "\n") - len(END))
        return F.transform(F.split(inner, r"<\|next\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    cut = F.transform("loss_spans", lambda s: F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return formatted.select(
        "conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), unescape(F.array_join(cut, "")).alias("loss_text"), "formatted"
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -1, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    back = read_chats(format_chats(turns.unionByName(probe)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens,
    length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS chars,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) AS role_chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens THEN 8 + role_chars + 1 + 8 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
