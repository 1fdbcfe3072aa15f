"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from .align import op11_tokenizer_alignment
from .bpe import op2_bpe
from .decontaminate import op4_decontamination
from .html_text import op12_html_extraction
from .jaccard_join import op10_jaccard_join
from .language import op3_language_id
from .pii import op6_pii
from .quality import op5_quality
from .shard import op1_sharding
from .token_count import op7_token_counts
from .topk import OP8_SQL, op8_topk
from .toxicity import op9_toxicity


def queries() -> dict:
    found = (op1_sharding, op2_bpe, op3_language_id, op4_decontamination, op5_quality, op6_pii, op7_token_counts, op8_topk, op9_toxicity, op10_jaccard_join, op11_tokenizer_alignment, op12_html_extraction)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op8_topk": OP8_SQL}
