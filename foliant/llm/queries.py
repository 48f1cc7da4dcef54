"""Registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations
from .piece_coder import op4_sentencepiece_backtracking
from .simhash import op6_simhash_tiles
from .quality import op1_nb_support_vectors
from .toxicity import op9_crf_toxicity
from .reshard import op2_min_cost_flow_resharding
from .decontaminate import OP8_SQL, op8_positional_index
from .pii import op3_disclosure_sanitiser
from .nearest import op5_stable_projection_search
from .substrings import op10_repeated_phrase_automata
from .interpolation import op7_deleted_interpolation
from .merge_automaton import op11_merge_automaton
from .scalar_tables import OP12_SQL, op12_scalar_tables
from .walsh_codes import OP13_SQL, op13_walsh_codes

QUERIES = {
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op10_repeated_phrase_automata": op10_repeated_phrase_automata,
    "op5_stable_projection_search": op5_stable_projection_search,
    "op3_disclosure_sanitiser": op3_disclosure_sanitiser,
    "op8_positional_index": op8_positional_index,
    "op2_min_cost_flow_resharding": op2_min_cost_flow_resharding,
    "op9_crf_toxicity": op9_crf_toxicity,
    "op1_nb_support_vectors": op1_nb_support_vectors,
    "op4_sentencepiece_backtracking": op4_sentencepiece_backtracking,
    "op6_simhash_tiles": op6_simhash_tiles,
    "op11_merge_automaton": op11_merge_automaton,
    "op12_scalar_tables": op12_scalar_tables,
    "op13_walsh_codes": op13_walsh_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op8_positional_index": OP8_SQL,
    "op12_scalar_tables": OP12_SQL,
    "op13_walsh_codes": OP13_SQL,
}
