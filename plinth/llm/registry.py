"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe_codec import op6_bpe_codec
from .collocations import OP13_SQL, op13_phrase_collocations
from .decontaminate import op2_decontaminate
from .html_extract import op12_html_extract
from .line_dedup import OP5_SQL, op5_line_dedup
from .minhash_near_dedup import op10_minhash_near_dedup
from .pii_pseudonyms import op4_pii_pseudonyms
from .quality_rules import OP7_SQL, op7_quality_rules
from .ranked_search import OP11_SQL, op11_ranked_search
from .suffix_dedup import op9_suffix_dedup
from .toxicity import op3_toxicity
from .url_filters import OP8_SQL, op8_url_filters
from .warc_derive import OP1_SQL, op1_warc_derivatives

QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_html_extract": op12_html_extract,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES = {
    "op1_warc_derivatives": OP1_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_url_filters": OP8_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_phrase_collocations": OP13_SQL,
}
