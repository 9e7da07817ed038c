"""op1: chat formatting of all conversations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_back

HARD = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "conv_id long, turn long, role string, text string"
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], schema)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    read = read_back(format_chats(rows.unionByName(hard)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
        F.col("escape_level").cast("int").alias("escape_level"),
        "round_trip",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), convs AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns_text,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss_text,
    sum(14 + length(role) + length(text)) AS plain,
    bool_or(regexp_matches(text, '</turn>|### |<\|chat') OR regexp_matches(role, '</turn>|### |<\|chat')) AS control,
    bool_or(text LIKE '%\' OR role LIKE '%: %') AS hard,
    sum(len(regexp_extract_all(text, '</turn>|### |<\|chat')) + len(regexp_extract_all(role, '</turn>|### |<\|chat'))) AS marks,
    sum(len(regexp_extract_all(text, '[\\<#:]')) + len(regexp_extract_all(role, '[\\<#:]'))) AS specials
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns_text) AS turns_sha256, length(loss_text) AS loss_chars,
  sha256(loss_text) AS loss_sha256,
  CAST(plain + CASE WHEN hard THEN 17 + specials WHEN control THEN 9 + marks ELSE 9 END AS BIGINT) AS formatted_chars,
  CAST(CASE WHEN hard THEN 2 WHEN control THEN 1 ELSE 0 END AS INTEGER) AS escape_level,
  true AS round_trip
FROM convs
"""
