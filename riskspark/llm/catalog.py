"""Queries of this folder: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

from riskspark.llm.bpe import op2_byte_bpe
from riskspark.llm.chat import op3_reply_trees
from riskspark.llm.lpt import op10_lpt_shards
from riskspark.llm.minhash import op1_minhash_dedup
from riskspark.llm.mixing import op9_temperature_mix
from riskspark.llm.negatives import SQL as OP13_SQL
from riskspark.llm.negatives import op13_hard_negatives
from riskspark.llm.neighbours import op6_hilbert_neighbours
from riskspark.llm.ngram import op4_ngram_perplexity
from riskspark.llm.repair import op11_target_alignment
from riskspark.llm.secrets import SQL as OP12_SQL
from riskspark.llm.secrets import op12_secret_ownership
from riskspark.llm.suffixes import op5_suffix_dedup
from riskspark.llm.toxicity import op8_factorization_toxicity
from riskspark.llm.url_rules import op7_url_rules

QUERIES = [op1_minhash_dedup, op2_byte_bpe, op3_reply_trees, op4_ngram_perplexity, op5_suffix_dedup,
           op6_hilbert_neighbours, op7_url_rules, op8_factorization_toxicity, op9_temperature_mix, op10_lpt_shards,
           op11_target_alignment, op12_secret_ownership, op13_hard_negatives]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


#: conversations rebuilt from the table itself: the formatted text must read back as this
OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES
    (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'),
    (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
sized AS (
  SELECT *, length(role) + length(text)
    + (length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')))
    + (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')))
    + length('<|turn|>') + length('<|text|>') + length('<|end|>') AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_reply_trees": OP3_SQL, "op12_secret_ownership": OP12_SQL, "op13_hard_negatives": OP13_SQL}
