"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of one role become one
message, and the messages are joined to one string:

    <|role|>text<|+|>text</s>

`<|+|>` parts the turns that were merged. Control strings inside roles and texts are escaped: their
first character becomes an entity, and an ampersand that would read as an entity is escaped too, so
`unescape(escape(x)) == x` for every x. All other characters stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, JOIN = "</s>", "<|+|>"
#: What a text must not hold unescaped, by its first character's entity.
CONTROLS = {"&lt;": r"<(?=\||/?s>|</?SYS>>)", "&lb;": r"\[(?=/?INST\])", "&vb;": r"\|(?=>)"}
FIRST = {"&lt;": "<", "&lb;": "[", "&vb;": "|"}
ENTITY = r"(?=(amp|lt|lb|vb);)"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, f"&{ENTITY}", "&amp;")
    for entity, pattern in CONTROLS.items():
        text = F.regexp_replace(text, pattern, entity)
    return text


def unescape(text: Column) -> Column:
    for entity, first in FIRST.items():
        text = F.replace(text, F.lit(entity), F.lit(first))
    return F.regexp_replace(text, f"&amp;{ENTITY}", "&")


def messages(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, messages array<struct<role, texts array<string>>>.

    Turns are ordered by turn (null first), ties by role and text; repeated rows stay. A null role or
    text is empty. Rows with a null conv_id are one conversation. Columns beyond the four are ignored.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = turns.select(F.col(conv_id).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    n = F.size("t")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", F.greatest(i - 2, F.lit(0)))["role"]))
    out = out.withColumn("starts", starts)

    def message(at: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), n + 1)
        return F.struct(F.get("t", at - 1)["role"].alias("role"), F.transform(F.slice("t", at, stop - at), lambda x: x["text"]).alias("texts"))

    return out.select("conv_id", F.transform("starts", message).alias("messages"))


def formatted(turns: DataFrame, **names: str) -> DataFrame:
    """conv_id, formatted string: the template of this module over `messages`."""

    def render(m: Column) -> Column:
        return F.concat(F.lit("<|"), escape(m["role"]), F.lit("|>"), F.array_join(F.transform(m["texts"], escape), JOIN), F.lit(END))

    return messages(turns, **names).select("conv_id", F.array_join(F.transform("messages", render), "").alias("formatted"))


def parsed(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Reads `formatted` back: turns array<struct<role, text>>, and loss_text, the unescaped texts of
    loss_role in order, over which a trainer takes the loss; loss_spans has their places in `formatted`
    (start and length in code points, one span for each turn)."""
    parts = F.filter(F.split("formatted", END), lambda x: x != "")

    def turns_of(part: Column) -> Column:
        body = F.substring_index(part, "|>", 1)
        role = unescape(F.substr(body, F.lit(3)))
        texts = F.split(F.substr(part, F.length(body) + 3), r"<\|\+\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text"), F.length(x).alias("n")))

    rows = rows.withColumn("parts", parts).withColumn("turns", F.flatten(F.transform("parts", turns_of)))
    loss = F.filter("turns", lambda x: x["role"] == loss_role)
    # a message is <|role|> + texts parted by <|+|> + </s>
    head = F.transform("parts", lambda p: F.struct(F.length(p).alias("n"), F.length(F.substring_index(p, "|>", 1)).alias("h"), F.split(F.substr(p, F.length(F.substring_index(p, "|>", 1)) + 3), r"<\|\+\|>").alias("x"), unescape(F.substr(F.substring_index(p, "|>", 1), F.lit(3))).alias("r")))
    at = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def place(acc: Column, m: Column) -> Column:
        texts = F.aggregate(m["x"], F.struct((acc["at"] + m["h"] + 2).alias("at"), acc["out"].alias("out")), lambda a, x: F.struct((a["at"] + F.length(x) + len(JOIN)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), F.length(x).alias("length")))).alias("out")))
        return F.struct((acc["at"] + m["n"] + len(END)).alias("at"), F.when(m["r"] == loss_role, texts["out"]).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(head, at, place, lambda a: a["out"])
    keep = [c for c in rows.columns if c not in ("parts", "turns")]
    return rows.select(*keep, F.transform("turns", lambda x: F.struct(x["role"], x["text"])).alias("turns"), F.array_join(F.transform(loss, lambda x: x["text"]), "").alias("loss_text"), spans.alias("loss_spans"))


def digests(turns: DataFrame, **names: str) -> DataFrame:
    """Per conversation, read back from its formatted string: counts and digests of turns and loss text."""
    out = parsed(formatted(turns, **names))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(rows.unionByName(probe))


#: formatted_chars follows from the escapes and the marks; DuckDB replays both.
ORACLE = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER w AS rn,
    CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS opens
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *,
    length(text)
      + 4 * length(regexp_replace(regexp_replace(text, '&(amp|lt|lb|vb);', chr(1), 'g'), '[^' || chr(1) || ']', '', 'g'))
      + 3 * ((length(text) - length(replace(text, '<|', '<'))) + (length(text) - length(replace(text, '</s>', '</s')))
           + (length(text) - length(replace(text, '<s>', '<s'))) + (length(text) - length(replace(text, '[INST]', '[INST')))
           + (length(text) - length(replace(text, '[/INST]', '[/INST'))) + (length(text) - length(replace(text, '|>', '|')))
           + (length(text) - length(replace(text, '<<SYS>>', '<<SYS>'))) + (length(text) - length(replace(text, '<</SYS>>', '<</SYS>')))) AS n
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN opens = 1 THEN 4 + length(role) + 4 ELSE 5 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
