"""The queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from .ann import op8_ann
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .jaccard_join import op12_jaccard
from .licenses import op10_licenses
from .mixing import op3_mixing
from .near_dedup import op2_near_dedup
from .packing import op5_packing
from .periodic_runs import op13_runs
from .substring_dedup import op1_substring_dedup
from .surrogates import op7_surrogates
from .token_alignment import op11_alignment
from .toxicity import op4_toxicity
from .url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_surrogates": op7_surrogates,
    "op8_ann": op8_ann,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_licenses": op10_licenses,
    "op11_alignment": op11_alignment,
    "op12_jaccard": op12_jaccard,
    "op13_runs": op13_runs,
}

ORACLE_SQL = {
    "op6_url_filter": OP6_SQL,
    "op9_exact_dedup": OP9_SQL,
}
