"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, exact, huffman, jaccard, katz, langid, lines, mixing, quality, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_token_files": huffman.op3_token_files,
    "op4_bpe": bpe.op4_bpe,
    "op5_lm_scores": katz.op5_lm_scores,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_language": langid.op10_language,
}
SQL = {"op2_exact_dedup": exact.SQL, "op9_line_dedup": lines.SQL}
