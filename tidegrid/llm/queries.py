"""The queries of this subpackage, by name, and the SQL that checks them where SQL can."""

from __future__ import annotations

from .language import op5_language_id
from .lines import OP1_SQL, op1_line_dedup
from .mixing import op2_mixing
from .neardup import op10_minhash_near_dedup
from .oracles import OP9_SQL, OP10_SQL
from .packing import op6_packing
from .phrases import OP11_SQL, op11_phrase_mining
from .privacy import op3_pii
from .quality import op8_quality_resampling
from .suffixes import op4_suffix_array_dedup
from .topk import OP13_SQL, op13_exact_top_k
from .variants import OP12_SQL, op12_spelling_variants
from .vectors import op7_nearest_neighbours, op9_embedding_near_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_mixing,
        op3_pii,
        op4_suffix_array_dedup,
        op5_language_id,
        op6_packing,
        op7_nearest_neighbours,
        op8_quality_resampling,
        op9_embedding_near_dedup,
        op10_minhash_near_dedup,
        op11_phrase_mining,
        op12_spelling_variants,
        op13_exact_top_k,
    )
}
ORACLES = {
    "op1_line_dedup": OP1_SQL, "op9_embedding_near_dedup": OP9_SQL, "op10_minhash_near_dedup": OP10_SQL, "op11_phrase_mining": OP11_SQL,
    "op12_spelling_variants": OP12_SQL, "op13_exact_top_k": OP13_SQL,
}
