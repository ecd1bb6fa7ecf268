"""The queries of this folder: one per operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import chat_format, decontaminate, embedding_dedup, language_id, license_scan, near_copies, packing, quality, url_filter, warc

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_packing": packing.op5_packing,
    "op6_language_id": language_id.op6_language_id,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_near_copies": near_copies.op8_near_copies,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_warc": warc.op10_warc,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_chat_format": chat_format.OP1_SQL, "op4_embedding_dedup": embedding_dedup.OP4_SQL, "op8_near_copies": near_copies.OP8_SQL, "op9_url_filter": url_filter.OP9_SQL, "op10_warc": warc.OP10_SQL}
