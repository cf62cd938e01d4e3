"""The registered queries of this package and their SQL."""

from __future__ import annotations

from .alignment import op12_alignment
from .audio import op9_audio
from .context_tree import op5_context_tree
from .decontamination import op4_decontamination
from .filter_audit import OP13_SQL, op13_filter_audit
from .jaccard import op11_jaccard
from .mixing import OP7_SQL, op7_mixing
from .quality import op6_quality
from .sharding import op3_hilbert
from .simhash import op1_simhash
from .token_records import op8_token_records
from .toxicity import op2_toxicity
from .warc import OP10_SQL, op10_warc


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_toxicity": op2_toxicity,
        "op3_hilbert": op3_hilbert,
        "op4_decontamination": op4_decontamination,
        "op5_context_tree": op5_context_tree,
        "op6_quality": op6_quality,
        "op7_mixing": op7_mixing,
        "op8_token_records": op8_token_records,
        "op9_audio": op9_audio,
        "op10_warc": op10_warc,
        "op11_jaccard": op11_jaccard,
        "op12_alignment": op12_alignment,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op10_warc": OP10_SQL, "op13_filter_audit": OP13_SQL}
