"""Queries of the corpus operators and the SQL that some of them can be held against."""

from quarry.llm import bpe, decontaminate, divergence, embeddings, exact, packing, periodic, quality, secrets, simhash, substrings, urls, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_suffix_dedup": substrings.op2_suffix_dedup,
    "op3_url_filter": urls.op3_url_filter,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_secrets": secrets.op5_secrets,
    "op6_packing": packing.op6_packing,
    "op7_embedding_near_dedup": embeddings.op7_embedding_near_dedup,
    "op8_warc": warc.op8_warc,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality": quality.op10_quality,
    "op11_divergence": divergence.op11_divergence,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_decontamination": decontaminate.op13_decontamination,
}
ORACLE_SQL = {"op3_url_filter": urls.OP3_SQL, "op4_exact_dedup": exact.OP4_SQL, "op11_divergence": divergence.OP11_SQL, "op13_decontamination": decontaminate.OP13_SQL}
