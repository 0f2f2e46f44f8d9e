"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import op5_chat_format
from .html import op9_html_main_text
from .langid import op2_language_id
from .mixing import op10_mix_sources
from .omh import op6_order_minhash
from .packing import op8_pack_documents
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .simhash import op1_simhash_dedup
from .substring import op4_substring_dedup
from .token_files import op11_token_files
from .topk import OP3_SQL, op3_exact_top_k
from .urls import OP7_SQL, op7_url_filter
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_language_id": op2_language_id,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_order_minhash": op6_order_minhash,
    "op7_url_filter": op7_url_filter,
    "op8_pack_documents": op8_pack_documents,
    "op9_html_main_text": op9_html_main_text,
    "op10_mix_sources": op10_mix_sources,
    "op11_token_files": op11_token_files,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE = {
    "op3_exact_top_k": OP3_SQL,
    "op7_url_filter": OP7_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
