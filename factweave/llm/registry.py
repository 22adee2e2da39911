"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bag_search, bpe, exact_dedup, hard_negatives, html_text, langid, maxscore, media, mixing, quality, repeats, simhash, url_filter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_simhash": simhash.op2_simhash,
    "op3_importance_resampling": quality.op3_importance_resampling,
    "op4_html_text": html_text.op4_html_text,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_language_id": langid.op7_language_id,
    "op8_media_jpeg": media.op8_media_jpeg,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_repeats": repeats.op10_repeats,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_maxscore": maxscore.op12_maxscore,
    "op13_bag_search": bag_search.op13_bag_search,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_maxscore": maxscore.ORACLE_SQL,
    "op13_bag_search": bag_search.ORACLE_SQL,
}
