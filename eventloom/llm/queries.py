"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from eventloom.llm import bpe_chunks, decontam, embed_ego, html_blocks, minhash, secrets, token_files, toolcalls, toxicity, warc_zdict
from eventloom.llm.common import small_batches


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _modest(query):
    def run(spark, sf_dir: str):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_ego_join": embed_ego.op1_ego_join,
    "op2_html_blocks": html_blocks.op2_html_blocks,
    "op3_entropy_secrets": secrets.op3_entropy_secrets,
    "op4_token_files": token_files.op4_token_files,
    "op5_latent_decontamination": decontam.op5_latent_decontamination,
    "op6_bpe_chunks": bpe_chunks.op6_bpe_chunks,
    "op7_minhash_multi_index": minhash.op7_minhash_multi_index,
    "op8_warc_zdict": warc_zdict.op8_warc_zdict,
    "op9_tool_calls": toolcalls.op9_tool_calls,
    "op10_cnn_toxicity": toxicity.op10_cnn_toxicity,
    "pipeline": _pipeline,
}
QUERIES = {name: _modest(query) for name, query in QUERIES.items()}
ORACLES = {
    "op1_ego_join": embed_ego.OP1_SQL,
    "op7_minhash_multi_index": minhash.OP7_SQL,
    "op8_warc_zdict": warc_zdict.OP8_SQL,
    "op9_tool_calls": toolcalls.OP9_SQL,
}
