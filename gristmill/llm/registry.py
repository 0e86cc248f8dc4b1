"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from gristmill.llm import decontaminate, dialogue, embeddings, fim, html_extract, language_id, lm_score, mixing, pii, quality, secret_scan, sharding, simhash, sql

QUERIES = {f.__name__: f for f in (decontaminate.op1_decontaminate, simhash.op2_simhash, language_id.op3_language_id, pii.op4_pii, secret_scan.op5_secret_scan, sharding.op6_sharding, lm_score.op7_lm_scoring, mixing.op8_mixing, html_extract.op9_html_extract, embeddings.op10_embedding_dedup, dialogue.op11_conversation_repair, quality.op12_quality_classifier, fim.op13_fill_in_middle)}
SQL: dict[str, str] = sql.SQL
