"""Queries of this subpackage for the driver."""

from __future__ import annotations

from . import bpe, chat, clusters, embedding, exact_dedup, html, licences, mixing, quality, simhash, substrings, token_files, whitening


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_bpe": bpe.op2_bpe,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_licence_scan": licences.op4_licence_scan,
        "op5_simhash": simhash.op5_simhash,
        "op6_embedding": embedding.op6_embedding,
        "op7_quality": quality.op7_quality,
        "op8_html": html.op8_html,
        "op9_substring_dedup": substrings.op9_substring_dedup,
        "op10_chat_format": chat.op10_chat_format,
        "op11_whitening": whitening.op11_whitening,
        "op12_clusters": clusters.op12_clusters,
        "op13_token_files": token_files.op13_token_files,
    }


def oracle_sql() -> dict:
    return {"op1_mix_sources": mixing.OP1_SQL, "op3_exact_dedup": exact_dedup.OP3_SQL, "op4_licence_scan": licences.oracle_sql(), "op10_chat_format": chat.OP10_SQL, "op12_clusters": clusters.OP12_SQL}
