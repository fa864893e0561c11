"""The registered queries of this folder; each applies its operator to its whole table."""

from __future__ import annotations

from .ans import op5_ans_tokens
from .conversation_repair import op13_conversation_repair
from .fingerprints import op3_audio_fingerprints
from .langid import op2_language_id
from .mixing import op9_mixing
from .neardup import op4_near_duplicates
from .packing import op8_packing
from .prefix_trie import op11_prefix_trie
from .quality_classifier import op10_quality_classifier
from .quality_rules import op7_quality_rules
from .secrets import op1_secrets
from .token_counts import op6_token_counts
from .toxicity import op12_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_language_id, op3_audio_fingerprints, op4_near_duplicates, op5_ans_tokens, op6_token_counts,
        op7_quality_rules, op8_packing, op9_mixing, op10_quality_classifier, op11_prefix_trie, op12_toxicity, op13_conversation_repair,
    )
}
ORACLE_SQL: dict[str, str] = {}
