"""Chat formatting in Spark expressions: turns become one training text with a loss mask.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role share
one block; the parts are concatenated once. Template: ``<|im_start|>role<|im_msg|>text`` then, for
each further text of the same role, ``<|im_sep|>text``, and ``<|im_end|>`` and a newline.

Control strings inside roles and texts are escaped with a backslash after their first character,
backslashes by doubling; dropping the backslash before any character undoes it. So no control string
of this or of other common templates is left inside a text, and no text is lost.

The mask lists spans (start and length in code points) of the formatted text: one for each
assistant text, escaped as it stands there. ``read_back`` takes only the formatted text and the mask.

Defined results: null role and null text are empty; ties in turn go by role, then text; repeated rows
are turns of their own; rows without a conversation id form one conversation with a null id; very long
texts stay whole; only the four named columns are read, so others can't clash; an empty table gives an
empty one. A conversation is one row, held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MSG, SEP, END = "<|im_start|>", "<|im_msg|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings that never stand in an escaped text; each is broken after its first character.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its id, formatted, and loss (spans under the mask)."""
    clean = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    at = lambda i: F.get("turns", i)["role"]

    def part(t: Column, i: Column) -> Column:
        first = (i == 0) | (at(i - 1) != t["role"])
        last = (i == F.size("turns") - 1) | (at(i + 1) != t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(START), escape(t["role"]), F.lit(MSG))).otherwise(F.lit(SEP)).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(last, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (t["role"] == LOSS_ROLE).alias("loss"),
        )

    parts = turns.select("conv_id", F.transform("turns", part).alias("parts"))
    length = lambda p, f: F.length(p[f])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(a: Column, p: Column) -> Column:
        start = a["at"] + length(p, "head")
        end = start + length(p, "body")
        span = F.struct(start.alias("start"), length(p, "body").alias("length"))
        return F.struct((end + length(p, "tail")).alias("at"), F.when(p["loss"], F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.aggregate("parts", zero, walk)["spans"].alias("loss"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role and text, in order) and the texts under the mask, all unescaped."""
    quote = lambda s: "\\Q" + s + "\\E"
    blocks = F.slice(F.split("formatted", quote(START), -1), 2, F.greatest(F.size(F.split("formatted", quote(START), -1)) - 1, F.lit(0)))

    def texts(block: Column) -> Column:
        halves = F.split(F.regexp_replace(block, quote(END) + r"\z", ""), quote(MSG), -1)
        role = unescape(halves[0])
        return F.transform(F.split(halves[1], quote(SEP), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return chats.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(blocks, texts)).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("learned"),
    )


def chat_report(chats: DataFrame) -> DataFrame:
    """The query's columns, all read back from the formatted text and the mask."""
    back = read_back(chats)
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def probe(like: DataFrame) -> DataFrame:
    """Conversation -7: two turns that both say control strings of other templates."""
    says = F.lit("</s>[INST] ok [/INST]")
    rows = like.sparkSession.range(0, 2, 1, 1)
    return rows.select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text"))


def _oracle() -> str:
    esc = "replace({}, '\\', '\\\\')"
    for c in CONTROL:
        esc = f"replace({esc}, '{c}', '{c[0]}\\{c[1:]}')"
    n = {k: len(v) for k, v in (("start", START), ("msg", MSG), ("sep", SEP), ("end", END))}
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
u AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum(length({esc.format("text")}) + CASE WHEN before IS NULL OR before <> role THEN {n["start"] + n["msg"] + n["end"]} + length({esc.format("role")}) ELSE {n["sep"]} END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id"""


ORACLE = _oracle()
