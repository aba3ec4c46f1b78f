"""The text operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from gridloom.llm.embed_dedup import OP5_SQL, op5_embedding_dedup
from gridloom.llm.filter_audit import OP13_SQL, op13_filter_audit
from gridloom.llm.fingerprint import op4_fingerprints
from gridloom.llm.html_extract import op1_html_extraction
from gridloom.llm.minhash import OP6_SQL, op6_minhash
from gridloom.llm.mixing import OP7_SQL, op7_mixing
from gridloom.llm.packing import op12_packing
from gridloom.llm.pieces import op8_sentencepiece
from gridloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from gridloom.llm.quality import op9_quality
from gridloom.llm import secrets
from gridloom.llm.secrets import op3_secret_scans
from gridloom.llm.shard import op2_sharding
from gridloom.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_sharding": op2_sharding,
    "op3_secret_scans": op3_secret_scans,
    "op4_fingerprints": op4_fingerprints,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_minhash": op6_minhash,
    "op7_mixing": op7_mixing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scans": secrets.oracle_sql(),
    "op5_embedding_dedup": OP5_SQL,
    "op6_minhash": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
