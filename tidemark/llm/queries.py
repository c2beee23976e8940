"""Queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import sql
from .decontam import op4
from .html_extract import op5
from .near_dedup import op1
from .packing import op9
from .quality import op8
from .sharding import op2
from .span_dedup import op10
from .token_shards import op3
from .toxicity import op7
from .warc import op6


def queries() -> dict:
    out = {"op1_minhash_dedup": op1, "op2_shard": op2, "op3_token_shards": op3, "op4_decontaminate": op4}
    out |= {"op5_main_text": op5, "op6_warc": op6, "op7_toxicity": op7, "op8_quality": op8, "op9_pack": op9, "op10_span_dedup": op10}
    return out


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
