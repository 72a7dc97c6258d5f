"""The queries of this folder and the SQL that says the same where SQL can."""

from loomgraph.llm.katz import op1_katz_backoff
from loomgraph.llm.langmask import op2_language_bitmask
from loomgraph.llm.merkle import OP11_SQL, op11_merkle_manifest
from loomgraph.llm.packing import op5_pattern_packing
from loomgraph.llm.raking import op4_raked_mixture
from loomgraph.llm.rules import op9_adaptive_rules
from loomgraph.llm.secretscan import OP12_SQL, op12_secret_ledger
from loomgraph.llm.simhash import op10_simhash_groups
from loomgraph.llm.spelling import OP13_SQL, op13_spelling_trie
from loomgraph.llm.topk import OP7_SQL, op7_exact_top_k
from loomgraph.llm.toxgru import op8_recurrent_toxicity
from loomgraph.llm.warc import op6_warc_records
from loomgraph.llm.zquality import op3_compression_quality

OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""


def queries():
    return {
        f.__name__: f
        for f in (
            op1_katz_backoff,
            op2_language_bitmask,
            op3_compression_quality,
            op4_raked_mixture,
            op5_pattern_packing,
            op6_warc_records,
            op7_exact_top_k,
            op8_recurrent_toxicity,
            op9_adaptive_rules,
            op10_simhash_groups,
            op11_merkle_manifest,
            op12_secret_ledger,
            op13_spelling_trie,
        )
    }


def oracle_sql():
    return {"op6_warc_records": OP6_SQL, "op7_exact_top_k": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_secret_ledger": OP12_SQL, "op13_spelling_trie": OP13_SQL}
