"""The queries of the corpus operators and the SQL that gives the same rows, where SQL can express it."""

from __future__ import annotations

from . import importance, line_dedup, merkle, mixing, near_dedup, substring_dedup
from .chat import op8_chat
from .decontamination import op7_decontamination
from .embedding_dedup import op2_embedding_dedup
from .importance import op13_importance
from .line_dedup import op3_line_dedup
from .lm_score import op4_lm_score
from .merkle import op11_merkle
from .mixing import op5_mixing
from .near_dedup import op10_near_dedup
from .pii import op12_pii
from .quality import op6_quality
from .substring_dedup import op9_substring_dedup
from .toxicity import op1_toxicity


def queries() -> dict:
    found = (op1_toxicity, op2_embedding_dedup, op3_line_dedup, op4_lm_score, op5_mixing, op6_quality, op7_decontamination, op8_chat, op9_substring_dedup, op10_near_dedup, op11_merkle, op12_pii, op13_importance)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.SQL, "op5_mixing": mixing.SQL, "op9_substring_dedup": substring_dedup.SQL, "op10_near_dedup": near_dedup.SQL, "op11_merkle": merkle.SQL, "op13_importance": importance.SQL}
