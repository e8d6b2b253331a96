"""The queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from lorekeep.llm import exact_dedup, framed_fim, metric_join, page_text, piece_codec, quality_mil, secret_links, shingle_join
from lorekeep.llm import source_mix, token_files, toxic_segments, vector_codes, warc_convert

QUERIES = {
    "op1_toxic_segments": toxic_segments.op1,
    "op2_token_files": token_files.op2,
    "op3_source_mix": source_mix.op3,
    "op4_page_text": page_text.op4,
    "op5_piece_codec": piece_codec.op5,
    "op6_metric_join": metric_join.op6,
    "op7_shingle_join": shingle_join.op7,
    "op8_quality_mil": quality_mil.op8,
    "op9_secret_links": secret_links.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_warc_convert": warc_convert.op12,
    "op13_framed_fim": framed_fim.op13,
}
ORACLES = {
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_warc_convert": warc_convert.OP12_SQL,
    "op13_framed_fim": framed_fim.OP13_SQL,
}
