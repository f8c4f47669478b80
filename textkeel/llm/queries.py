"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, jaccard, licenses, mixing, perplexity, quality, secrets, sharding, suffixes, warc

QUERIES = {
    "op1_warc_archives": warc.op1_warc_archives,
    "op2_quality_nbsvm": quality.op2_quality_nbsvm,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_perplexity_rules": perplexity.op5_perplexity_rules,
    "op6_benchmark_decontamination": decontam.op6_benchmark_decontamination,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_extendible_sharding": sharding.op9_extendible_sharding,
    "op10_secret_ledger": secrets.op10_secret_ledger,
}
SQL = {
    "op1_warc_archives": warc.OP1_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op9_extendible_sharding": sharding.OP9_SQL,
}
