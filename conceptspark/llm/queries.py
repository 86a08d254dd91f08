"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conceptspark.llm.ann import op1_neighbours
from conceptspark.llm.bpe import op5_bpe
from conceptspark.llm.divergence import OP12_SQL, op12_quality_rules
from conceptspark.llm.flac import op4_flac
from conceptspark.llm.html_crf import op8_html
from conceptspark.llm.langid import op10_language_id
from conceptspark.llm.licenses import op9_license_scan
from conceptspark.llm.mixing import OP6_SQL, op6_mix
from conceptspark.llm.pfor import op7_token_files
from conceptspark.llm.quality import op3_quality
from conceptspark.llm.simhash import op2_simhash
from conceptspark.llm.talk_repair import OP11_SQL, op11_repair
from conceptspark.llm.variants import OP13_SQL, op13_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_flac": op4_flac,
    "op5_bpe": op5_bpe,
    "op6_mix": op6_mix,
    "op7_token_files": op7_token_files,
    "op8_html": op8_html,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_repair": op11_repair,
    "op12_quality_rules": op12_quality_rules,
    "op13_variants": op13_variants,
}
ORACLE_SQL: dict[str, str] = {"op6_mix": OP6_SQL, "op11_repair": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_variants": OP13_SQL}
