"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_formatting
from .language import op7_language_id
from .mixing import op9_mix_sources
from .neardup import OP6_SQL, op6_minhash_near_dedup
from .neighbours import op3_multiprobe_neighbours
from .packing import op10_best_fit_packing
from .privacy import op8_personal_data
from .quality import OP1_SQL, op1_quality_rules
from .tokens import op2_token_counts
from .wrappers import op4_html_extraction

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_token_counts,
        op3_multiprobe_neighbours,
        op4_html_extraction,
        op5_chat_formatting,
        op6_minhash_near_dedup,
        op7_language_id,
        op8_personal_data,
        op9_mix_sources,
        op10_best_fit_packing,
    )
}
SQL = {"op1_quality_rules": OP1_SQL, "op5_chat_formatting": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL}
