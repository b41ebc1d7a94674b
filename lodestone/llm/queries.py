"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm.decontaminate import op2_decontaminate
from lodestone.llm.factorisation import op12_factorisation
from lodestone.llm.html import op6_html
from lodestone.llm.language import op3_language
from lodestone.llm.merkle import OP13_SQL, op13_merkle
from lodestone.llm.packing import op5_packing
from lodestone.llm.phrases import OP11_SQL, op11_phrases
from lodestone.llm.pii import op4_pii
from lodestone.llm.quality import op8_quality
from lodestone.llm.secrets import op9_secrets
from lodestone.llm.sharding import OP1_SQL, SMALL_SQL, op1_sharding, small_shards
from lodestone.llm.simhash import op10_simhash
from lodestone.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontaminate": op2_decontaminate,
    "op3_language": op3_language,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_html": op6_html,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
    "op11_phrases": op11_phrases,
    "op12_factorisation": op12_factorisation,
    "op13_merkle": op13_merkle,
    "small_shards": small_shards,
}
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": OP1_SQL,
    "op11_phrases": OP11_SQL,
    "op13_merkle": OP13_SQL,
    "small_shards": SMALL_SQL,
}
