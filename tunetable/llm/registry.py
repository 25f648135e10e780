"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tunetable.llm import line_dedup, mixing, ranked_search, spelling, substring_dedup, warc
from tunetable.llm.ann import op9_nearest_neighbours
from tunetable.llm.decontamination import op10_benchmark_decontamination
from tunetable.llm.html_extraction import op7_html_extraction
from tunetable.llm.jaccard_join import op8_ngram_jaccard_join
from tunetable.llm.language_id import op6_language_id
from tunetable.llm.license_scan import op1_license_scan
from tunetable.llm.toxicity import op11_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        warc.op2_warc_revisits,
        line_dedup.op3_line_dedup,
        substring_dedup.op4_substring_dedup,
        mixing.op5_source_mixing,
        op6_language_id,
        op7_html_extraction,
        op8_ngram_jaccard_join,
        op9_nearest_neighbours,
        op10_benchmark_decontamination,
        op11_toxicity,
        ranked_search.op12_ranked_search,
        spelling.op13_spelling_variants,
    )
}

ORACLE: dict[str, str] = {
    "op2_warc_revisits": warc.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op5_source_mixing": mixing.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_spelling_variants": spelling.SQL,
}
