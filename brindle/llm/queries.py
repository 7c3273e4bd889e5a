"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, codes, fingerprints, lm, minhash, neighbours, packing, periods, pii, quality, sharding, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_pii": pii.op2_pii,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_bpe": bpe.op4_bpe,
    "op5_embeddings": neighbours.op5_embeddings,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op9_warc": warc.op9_warc,
    "op10_minhash": minhash.op10_minhash,
    "op8_sharding": sharding.op8_sharding,
    "op11_periods": periods.op11_periods,
    "op12_quality": quality.op12_quality,
    "op13_codes": codes.op13_codes,
}

ORACLE_SQL: dict[str, str] = {"op9_warc": warc.OP9_SQL}
