"""Chat formatting with a grammar round trip, in SQL functions only.

Grammar: ``conversation := turn*``, ``turn := "<s>[INST]" role "[/INST]" text "</s>"``. The parser cuts at ``</s>``,
takes the role up to the first ``[/INST]`` and undoes escapes (a backslash stands before a kept character). Escaping
puts a backslash behind the first character of every control string and of every backslash, so no control string is left
inside a role or text and the undoing is exact. Turns that hold neither are rendered as they are. The rendered text is
parsed again and compared with the source; a conversation that came back different would be escaped once more, and one
that never comes back identical ends the job.

Defined results: a null text or role is empty; null turns come first, turns with equal numbers are ordered by role
and text; repeated rows are turns of their own; a null conv_id is a conversation of its own. An empty table gives no
rows, further columns are ignored. One conversation becomes one record, so a conversation is one row by its nature;
conversations are gathered by id with partial lists inside the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
BEGIN, ROLE_END, END = "<s>[INST]", "[/INST]", "</s>"
#: A backslash, or the first character of a control string.
_ESCAPED = r"\\|\[(?=/?INST\])|<(?=/?s>)"
TRAINED_ROLE = "assistant"


def _escape(x: Column) -> Column:
    return F.regexp_replace(x, _ESCAPED, r"$0\\")


def _unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _written(turns: Column) -> Column:
    """The pieces of the formatted text, one per turn."""
    return F.transform(turns, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit(ROLE_END), t["text"], F.lit(END)))


def _pieces(formatted: Column) -> Column:
    """The formatted text cut behind every END; what follows the last one is left over."""
    parts = F.split(formatted, END)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """The turns that a formatted text holds: array of (role, text)."""
    def turn(piece: Column) -> Column:
        head = F.instr(piece, ROLE_END)
        return F.struct(
            _unescape(F.substring(piece, F.lit(len(BEGIN) + 1), head - F.lit(len(BEGIN) + 1))).alias("role"),
            _unescape(F.substring(piece, head + F.lit(len(ROLE_END)), F.length(piece))).alias("text"),
        )

    return F.transform(_pieces(formatted), turn)


def loss_spans(formatted: Column) -> Column:
    """Code-point spans of the formatted text that are trained on: array of (start, length), starts from 0."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(seen: Column, piece: Column) -> Column:
        head = F.instr(piece, ROLE_END) + F.lit(len(ROLE_END) - 1)
        size = F.length(piece)
        role = _unescape(F.substring(piece, F.lit(len(BEGIN) + 1), F.instr(piece, ROLE_END) - F.lit(len(BEGIN) + 1)))
        span = F.struct((seen["at"] + head).cast("bigint").alias("start"), (size - head).cast("bigint").alias("length"))
        return F.struct(
            (seen["at"] + size + F.lit(len(END))).cast("bigint").alias("at"),
            F.when(role == TRAINED_ROLE, F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"]).alias("spans"),
        )

    return F.aggregate(_pieces(formatted), start, step, lambda seen: seen["spans"])


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, source turns, formatted text, recovered turns and the loss spans."""
    empty = F.lit("")
    turns = rows.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"),
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    source = turns.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )
    def escaped(turns: str) -> Column:
        return F.transform(turns, lambda t: F.struct(_escape(t["role"]).alias("role"), _escape(t["text"]).alias("text")))

    # What conflicts with the grammar is escaped; all else is not touched by it.
    tried = source.withColumn("safe", escaped("turns")).withColumn("formatted", F.array_join(_written(F.col("safe")), ""))
    checked = tried.withColumn("recovered", parse(F.col("formatted")))
    last = checked.select(
        "conv_id", "turns",
        F.when(F.col("recovered") == F.col("turns"), F.col("formatted"))
        .otherwise(F.array_join(_written(escaped("safe")), "")).alias("formatted"),
    )
    return last.withColumn("recovered", parse(F.col("formatted"))).withColumn("loss_spans", loss_spans(F.col("formatted")))


def digest(chats: DataFrame) -> DataFrame:
    """What is read back from the formatted texts. A text that does not come back identical ends the job."""
    trained = F.transform("loss_spans", lambda s: _unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = chats.select(
        "conv_id",
        F.when(F.col("recovered") == F.col("turns"), F.col("recovered"))
        .otherwise(F.raise_error(F.lit("a conversation did not come back identical"))).alias("recovered"),
        F.array_join(trained, "").alias("trained"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("recovered").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars",
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The given rows and conversation -7, whose texts hold control strings."""
    spark = rows.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


#: DuckDB twin: the digest follows from the source, since the round trip is exact.
ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT *, len(regexp_extract_all(role, '\\|\[/?INST\]|</?s>')) + len(regexp_extract_all(text, '\\|\[/?INST\]|</?s>')) AS marks FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(role) + length(text) + marks) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""
