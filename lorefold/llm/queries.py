"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from lorefold.llm.decontaminate import op1_decontaminate
from lorefold.llm.fingerprint import op3_fingerprint
from lorefold.llm.html_text import op7_html_text
from lorefold.llm.katz import op5_katz_scores
from lorefold.llm.language_id import op8_language_id
from lorefold.llm.lexical_rank import OP12_SQL, op12_lexical_rank
from lorefold.llm.line_dedup import op10_line_dedup
from lorefold.llm.mixing import OP4_SQL, op4_mixing
from lorefold.llm.ngram_join import op6_ngram_join
from lorefold.llm.prefix_tree import op11_chat
from lorefold.llm.spelling import op13_spelling
from lorefold.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from lorefold.llm.token_count import op9_token_count

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_fingerprint": op3_fingerprint,
    "op4_mixing": op4_mixing,
    "op5_katz_scores": op5_katz_scores,
    "op6_ngram_join": op6_ngram_join,
    "op7_html_text": op7_html_text,
    "op8_language_id": op8_language_id,
    "op9_token_count": op9_token_count,
    "op10_line_dedup": op10_line_dedup,
    "op11_chat": op11_chat,
    "op12_lexical_rank": op12_lexical_rank,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op4_mixing": OP4_SQL,
    "op12_lexical_rank": OP12_SQL,
}
