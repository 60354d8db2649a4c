"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from .op1_media_chunks import op1_media_chunks
from .op2_quality import op2_quality
from .op3_suffix_dedup import op3_suffix_dedup
from .op4_license_scan import op4_license_scan
from .op5_token_files import op5_token_files
from .op6_jaccard_join import op6_jaccard_join
from .op7_packing import op7_packing
from .op8_sharding import op8_sharding
from .op9_sentencepiece import op9_sentencepiece
from .op10_winnowing import op10_winnowing
from .oracle import JACCARD_JOIN

QUERIES = {f.__name__: f for f in (op1_media_chunks, op2_quality, op3_suffix_dedup, op4_license_scan, op5_token_files, op6_jaccard_join, op7_packing, op8_sharding, op9_sentencepiece, op10_winnowing)}
ORACLE_SQL = {"op6_jaccard_join": JACCARD_JOIN}
