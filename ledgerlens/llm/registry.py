"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat_format import OP2_SQL, op2_chat_formatting
from .decontamination import op1_decontamination
from .language_id import op4_language_id
from .lexical_search import OP11_SQL, op11_ranked_search
from .line_dedup import OP6_SQL, op6_line_dedup
from .near_dup import op9_ngram_jaccard_join
from .piece_sampling import op8_sentencepiece
from .quality_classifier import op5_quality_classifier
from .quality_rules import OP10_SQL, op10_quality_rules
from .secret_scan import op3_secret_scan
from .simhash import op12_simhash
from .url_filters import OP7_SQL, op7_url_filters
from .whitening import op13_whitening

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_simhash": op12_simhash,
    "op13_whitening": op13_whitening,
}

#: The others (template matching, recursive decoding, learned models, sampling, similarity classes) are tested against
#: brute force, round trips or held-out accuracy.
ORACLES = {"op2_chat_formatting": OP2_SQL, "op6_line_dedup": OP6_SQL, "op7_url_filters": OP7_SQL, "op10_quality_rules": OP10_SQL, "op11_ranked_search": OP11_SQL}
