"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .importance import OP12_SQL, op12_importance
from .media import op1_media
from .mih import op8_nearest
from .mixing import OP11_SQL, op11_mix
from .neardup import op7_near_duplicates
from .packing import op5_pack
from .pieces import op6_pieces
from .pii import op4_pseudonyms
from .quality import op10_quality
from .repeats import op9_repeats
from .token_files import op3_token_files
from .toxicity import op2_toxicity
from .whitening import op13_whiten


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_toxicity": op2_toxicity,
        "op3_token_files": op3_token_files,
        "op4_pseudonyms": op4_pseudonyms,
        "op5_pack": op5_pack,
        "op6_pieces": op6_pieces,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_nearest": op8_nearest,
        "op9_repeats": op9_repeats,
        "op10_quality": op10_quality,
        "op11_mix": op11_mix,
        "op12_importance": op12_importance,
        "op13_whiten": op13_whiten,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_mix": OP11_SQL, "op12_importance": OP12_SQL}
