"""The queries of this subpackage and their SQL, for the repository's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from navspark.llm.bpe import op3_byte_bpe
from navspark.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from navspark.llm.html_text import op9_html_text
from navspark.llm.lang_id import op11_language
from navspark.llm.minhash import op5_minhash
from navspark.llm.mixing import op6_mixing
from navspark.llm.periodic import op12_runs
from navspark.llm.quality import op2_quality
from navspark.llm.ranked import OP13_SQL, op13_search
from navspark.llm.sharding import op1_sharding
from navspark.llm.suffix_dedup import op7_suffix_dedup
from navspark.llm.token_files import op10_token_files
from navspark.llm.warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_minhash": op5_minhash,
    "op6_mixing": op6_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html_text": op9_html_text,
    "op10_token_files": op10_token_files,
    "op11_language": op11_language,
    "op12_runs": op12_runs,
    "op13_search": op13_search,
}
ORACLES: dict[str, str] = {"op4_warc": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op13_search": OP13_SQL}
