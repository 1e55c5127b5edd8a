"""The queries of this subpackage: one for each operator, over whole tables, and the pipeline."""

from __future__ import annotations

from gridloom.llm.bpe import op8_bpe
from gridloom.llm.common import table
from gridloom.llm.dac import op10_token_files
from gridloom.llm.fst import op2_token_counts
from gridloom.llm import classify, dedup, mips, mixing, rules, sitetree, warc

QUERIES = {
    "op3_main_text": lambda spark, d: sitetree.op3_main_text(table(spark, d, "pages")),
    "op1_near_duplicates": lambda spark, d: dedup.op1_near_duplicates(table(spark, d, "documents")),
    "op6_topk": lambda spark, d: mips.op6_topk(table(spark, d, "embeddings")),
    "op9_quality": lambda spark, d: classify.op9_quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_mix": lambda spark, d: mixing.op7_mix(table(spark, d, "documents")),
    "op5_warc": warc.op5_warc,
    "op4_quality_rules": lambda spark, d: rules.op4_quality_rules(table(spark, d, "documents")),
    "op2_token_counts": lambda spark, d: op2_token_counts(table(spark, d, "documents")),
    "op8_bpe": lambda spark, d: op8_bpe(table(spark, d, "documents")),
    "op10_token_files": lambda spark, d: op10_token_files(table(spark, d, "documents"), spark),
}

#: DuckDB SQL of those that SQL can express.
ORACLES: dict[str, str] = {"op1_near_duplicates": dedup.ORACLE, "op4_quality_rules": rules.ORACLE, "op5_warc": warc.ORACLE, "op6_topk": mips.ORACLE}
