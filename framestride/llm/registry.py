"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from framestride.llm import centroids, host_rules, html_text, licenses, mixing, phrase_index, pu_quality, ranked, rans, secrets, sharding, simhash, warc

QUERIES = {
    "op1_rans_tokens": rans.op1_rans_tokens,
    "op2_pu_quality": pu_quality.op2_pu_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_sharding": sharding.op4_sharding,
    "op5_phrase_index": phrase_index.op5_phrase_index,
    "phrase_proximity": phrase_index.phrase_proximity,
    "op6_licenses": licenses.op6_licenses,
    "op7_warc": warc.op7_warc,
    "op8_secrets": secrets.op8_secrets,
    "op9_host_rules": host_rules.op9_host_rules,
    "op10_simhash": simhash.op10_simhash,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_centroids": centroids.op12_centroids,
    "op13_html_text": html_text.op13_html_text,
}

ORACLES = {
    "op3_mixing": mixing.SQL,
    "op4_sharding": sharding.SQL,
    "op5_phrase_index": phrase_index.SQL,
    "phrase_proximity": phrase_index.NEAR_SQL,
    "op6_licenses": licenses.SQL,
    "op7_warc": warc.SQL,
    "op8_secrets": secrets.SQL,
    "op9_host_rules": host_rules.SQL,
    "op11_ranked_search": ranked.SQL,
    "op12_centroids": centroids.SQL,
}
