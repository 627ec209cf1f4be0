"""The contract queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chunk_dedup import op10_chunk_dedup
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .decontaminate import op5_decontaminate
from .html_extract import op1_html_extract
from .licenses import op8_license_scan
from .near_dedup import op4_ngram_jaccard
from .packing import op3_packing
from .pii import op6_pii
from .quality import op7_quality
from .token_files import op9_token_files

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_decontaminate": op5_decontaminate,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_license_scan": op8_license_scan,
    "op9_token_files": op9_token_files,
    "op10_chunk_dedup": op10_chunk_dedup,
}

ORACLES: dict[str, str] = {"op2_exact_dedup": OP2_SQL}
