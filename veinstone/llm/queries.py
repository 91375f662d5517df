"""The subpackage's registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chaining import op7_substring_dedup
from .chat_format import OP2_SQL, op2_chat_formatting
from .collocations import OP13_SQL, op13_phrase_collocations
from .jaccard_join import OP4_SQL, op4_ngram_jaccard_join
from .kneser_ney import op9_quality_classifier
from .language_id import op6_language_id
from .maxscore import OP5_SQL, op5_exact_top_k
from .mixing import OP1_SQL, op1_mixing
from .pieces import op8_sentencepiece
from .runs import op11_periodic_runs
from .shards import op12_sharding
from .stable_ann import op3_approximate_neighbours
from .url_filter import op10_url_filters

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_approximate_neighbours": op3_approximate_neighbours,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_url_filters": op10_url_filters,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sharding": op12_sharding,
    "op13_phrase_collocations": op13_phrase_collocations,
}
SQL = {
    "op1_mixing": OP1_SQL,
    "op2_chat_formatting": OP2_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op13_phrase_collocations": OP13_SQL,
}
