"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import divergence, fingerprints, html_text, mining, mixing, near_dup, packing, quality, rules, secrets, suffix_dedup, token_files, tokens
from tessera.llm.common import documents, ship, table

QUERIES = {
    "op1_secret_scans": lambda spark, sf: secrets.op1(documents(spark, sf)),
    "op2_html_layout": lambda spark, sf: (ship(spark), html_text.op2(table(spark, sf, "pages")))[1],
    "op3_column_suffix_dedup": lambda spark, sf: suffix_dedup.op3(documents(spark, sf)),
    "op4_quality_rules": lambda spark, sf: rules.op4(documents(spark, sf)),
    "op5_quality_qda": lambda spark, sf: quality.op5(documents(spark, sf), table(spark, sf, "labels")),
    "op6_best_fit_packing": lambda spark, sf: packing.op6(documents(spark, sf)),
    "op7_token_counts": lambda spark, sf: tokens.op7(documents(spark, sf)),
    "op10_winnowing": lambda spark, sf: fingerprints.op10(documents(spark, sf)),
    "op8_source_mixing": lambda spark, sf: mixing.op8(documents(spark, sf)),
    "op8_training_order": lambda spark, sf: mixing.training_order(documents(spark, sf)),
    "op9_order_minhash": lambda spark, sf: near_dup.op9(documents(spark, sf)),
    "op11_hard_negatives": lambda spark, sf: (ship(spark), mining.op11(table(spark, sf, "embeddings")))[1],
    "op12_source_divergence": lambda spark, sf: divergence.op12(documents(spark, sf)),
    "op13_token_files": lambda spark, sf: token_files.op13(documents(spark, sf)),
}
ORACLES: dict[str, str] = {"op8_source_mixing": mixing.ORACLE, "op11_hard_negatives": mining.ORACLE, "op12_source_divergence": divergence.ORACLE}
