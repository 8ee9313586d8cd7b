"""The numbered queries: name -> callable, and the SQL of those that SQL can express."""

from __future__ import annotations

from keepwell.llm.columns import table
from keepwell.llm import chat, decontam, ranked
from keepwell.llm.compression import op6
from keepwell.llm.language import op3
from keepwell.llm.licences import op9
from keepwell.llm.main_text import op13
from keepwell.llm.packing import op2
from keepwell.llm.periods import op11
from keepwell.llm.resampling import op1
from keepwell.llm.simhash import op10
from keepwell.llm.suffix_dedup import op5
from keepwell.llm.toxicity import op4

def _bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    "op1_importance_resampling": lambda spark, d: op1(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_best_fit_packing": lambda spark, d: op2(table(spark, d, "documents"), _bpe(), short_first=True),
    "op3_language_id": lambda spark, d: op3(table(spark, d, "documents")),
    "op4_toxicity": lambda spark, d: op4(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_suffix_array_dedup": lambda spark, d: op5(table(spark, d, "documents")),
    "op6_compression_bands": lambda spark, d: op6(table(spark, d, "documents")),
    "op7_perspective_rotation": lambda spark, d: chat.op7(table(spark, d, "conversations")),
    "op8_benchmark_decontamination": lambda spark, d: decontam.op8(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_license_scan": lambda spark, d: op9(table(spark, d, "documents")),
    "op10_simhash_near_dedup": lambda spark, d: op10(table(spark, d, "documents")),
    "op11_periodic_runs": lambda spark, d: op11(table(spark, d, "documents")),
    "op12_ranked_search": lambda spark, d: ranked.op12(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_main_text": lambda spark, d: op13(table(spark, d, "pages")),
}

SQL: dict[str, str] = {
    "op7_perspective_rotation": chat.SQL,
    "op8_benchmark_decontamination": decontam.SQL,
    "op12_ranked_search": ranked.SQL,
}
