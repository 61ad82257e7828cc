"""Operator 8, chat formatting with typed content parts. Native: DataFrame functions only.

A turn is ``<s>role\\nbody</s>``. A visitor goes over a turn's content parts in order: text is escaped; an image,
audio or document part becomes the placeholder ``[type#position]``, and its reference and expanded token
count are recorded as an attachment. Escaping doubles every backslash and puts one behind the first
character of each control string, so no control string is left in a text; it is undone by
dropping each backslash and keeping the character behind it. Assistant bodies are under the loss mask.

A conversation is formatted by stretches of CHUNK turns, so that one long conversation is spread over tasks;
its output is its stretches in order. Texts are read back from the output: turns by splitting at
the end marks, loss text by the mask's spans.

Defined results: null role and null text are empty; turns go by number, then role, then text, null numbers
first; repeated rows are repeated turns; an empty table gives no rows (the query adds its own conversation);
rows with a null conv_id are one conversation; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CHUNK = 64
OPEN, CLOSE, BREAK = "<s>", "</s>", "\n"
#: First characters of control strings: sequence marks, instruction marks and placeholders.
CONTROL = r"<(?=/?s>)|\[(?=/?INST\]|(?:image|audio|document)#)"
#: Tokens that stand for one unit (patch, frame or page) of an attachment, and units where none are given.
EXPANSION = {"image": (1, 256), "audio": (1, 750), "document": (512, 1)}
LOSS_ROLES = ("assistant",)
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(BREAK), F.lit("\\" + BREAK))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a single text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))).cast(PARTS)


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*EXPANSION), F.lit(False))


def visit(part: Column, at: Column) -> Column:
    """What a part is in the output; unknown types count as text."""
    mark = F.concat(F.lit("["), part["type"], F.lit("#"), at.cast("string"), F.lit("]"))
    return F.when(_is_attachment(part), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def expanded(part: Column) -> Column:
    tokens = F.lit(0).cast("long")
    for kind, (each, units) in EXPANSION.items():
        tokens = F.when(part["type"] == kind, F.coalesce(part["units"], F.lit(units)).cast("long") * each).otherwise(tokens)
    return tokens


def format_turns(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, parts (PARTS). One row for each stretch of a conversation.

    conv_id, chunk, n_turns, formatted, spans (start and length of each body under the loss mask),
    attachments (turn, position, type, ref, tokens) and attachment_tokens.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    role = F.coalesce(F.col("role"), F.lit(""))
    found = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: _is_attachment(x["p"]))
    attachment = lambda x: F.struct(
        F.col("turn").alias("turn"), x["i"].alias("position"), x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), expanded(x["p"]).alias("tokens")
    )
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**63))).cast("long").alias("chunk"),
        role.alias("role"),
        F.concat(F.lit(OPEN), escape_role(role), F.lit(BREAK)).alias("head"),
        F.array_join(F.transform(parts, visit), "").alias("body"),
        F.transform(found, attachment).alias("attachments"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head", "attachments"))).alias("turns")
    grouped = rows.groupBy("conv_id", "chunk").agg(ordered)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def advance(acc: Column, t: Column) -> Column:
        head, body = F.length(t["head"]).cast("long"), F.length(t["body"]).cast("long")
        span = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        spans = F.when(t["role"].isin(*LOSS_ROLES), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + body + len(CLOSE)).alias("at"), spans.alias("spans"))

    attachments = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    out = grouped.select(
        "conv_id",
        "chunk",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("turns", start, advance, lambda acc: acc["spans"]).alias("spans"),
        attachments.alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, chunk, turns (role, text) and loss (texts under the mask), from formatted and spans alone.

    Placeholders stay in the texts as they stand.
    """
    turn = r"(?s)^<s>((?:[^\\\n]|\\.)*+)\n(.*)$"
    pieces = F.split("formatted", CLOSE)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = F.transform(whole, lambda p: F.struct(unescape(F.regexp_extract(p, turn, 1)).alias("role"), unescape(F.regexp_extract(p, turn, 2)).alias("text")))
    loss = F.transform("spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "chunk", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))


def digest(read: DataFrame) -> DataFrame:
    """One row for each conversation; its stretches are joined in order."""
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", F.struct("chunk", F.size("turns").cast("long").alias("n"), spelled.alias("spelled"), F.array_join("loss", "").alias("loss"), "chars").alias("s"))
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))

    def text(name: str) -> Column:
        return F.array_join(F.transform("s", lambda x: x[name]), "")

    def total(name: str) -> Column:
        return F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x[name])

    return joined.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(text("spelled").cast("binary"), 256).alias("turns_sha256"),
        F.length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(text("loss").cast("binary"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    turns = rows.unionByName(probe).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    return digest(read_back(format_turns(turns)))


ORACLE_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '<(/?s>)', '<x\\1', 'g'), '\\[(/?INST\\]|image#|audio#|document#)', '[x\\1', 'g') AS body,
  regexp_replace(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(10) || 'x'), '<(/?s>)', '<x\\1', 'g'), '\\[(/?INST\\]|image#|audio#|document#)', '[x\\1', 'g') AS head FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '') AS loss,
  sum(length(head) + length(body) + 8) AS chars FROM e GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""
