"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.chat import OP3_SQL, op3_chat_format
from foliant.llm.decontaminate import op6_decontaminate
from foliant.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from foliant.llm.html_text import op9_html_text
from foliant.llm.language import op7_language
from foliant.llm.mixing import op2_mixing
from foliant.llm.quality import op5_quality
from foliant.llm.secret_scan import op1_secret_scan
from foliant.llm.sharding import op8_sharding
from foliant.llm.simhash import op4_simhash
from foliant.llm.token_counts import op10_token_counts
from foliant.llm.url_filter import op12_url_filter
from foliant.llm.whitening import op11_whitening


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _over(op1_secret_scan, "documents"),
    "op2_mixing": _over(op2_mixing, "documents"),
    "op3_chat_format": _over(op3_chat_format, "conversations"),
    "op4_simhash": _over(op4_simhash, "documents"),
    "op5_quality": _over(op5_quality, "documents"),
    "op6_decontaminate": _over(op6_decontaminate, "documents", "benchmark"),
    "op7_language": _over(op7_language, "documents"),
    "op8_sharding": _over(op8_sharding, "documents"),
    "op9_html_text": _over(op9_html_text, "pages"),
    "op10_token_counts": _over(op10_token_counts, "documents"),
    "op11_whitening": _over(op11_whitening, "embeddings"),
    "op12_url_filter": _over(op12_url_filter, "pages"),
    "op13_hard_negatives": _over(op13_hard_negatives, "embeddings"),
}

ORACLE_SQL: dict[str, str] = {"op3_chat_format": OP3_SQL, "op13_hard_negatives": OP13_SQL}
