"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, html, language, mixing, packing, quality, simhash, toxicity, urls, vptree

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pack": packing.op2_pack,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_html": html.op5_html,
    "op6_language": language.op6_language,
    "op7_bpe": bpe.op7_bpe,
    "op8_urls": urls.op8_urls,
    "op9_quality": quality.op9_quality,
    "op10_neighbours": vptree.op10_neighbours,
}

ORACLES: dict[str, str] = {
    "op10_neighbours": vptree.ORACLE,
}
