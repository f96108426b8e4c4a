"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import op8_chat
from .hnsw import op3_hnsw
from .langid import op10_langid
from .lm import op2_lm
from .mixing import op5_mixing
from .packing import op9_packing
from .quality import op1_quality
from .simhash import op4_simhash
from .tokencount import op7_tokencount
from .topk import OP6_SQL, op6_topk

QUERIES = {f.__name__: f for f in (op1_quality, op2_lm, op3_hnsw, op4_simhash, op5_mixing, op6_topk, op7_tokencount, op8_chat, op9_packing, op10_langid)}
SQL = {"op6_topk": OP6_SQL}
