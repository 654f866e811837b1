"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from .bpe import op5_bpe
from .chroma import op10_chroma
from .decontaminate import op6_decontaminate
from .html import op2_html
from .language import op4_language
from .near_dedup import op8_minhash
from .resample import op12_resample
from .runs import op11_runs
from .secrets import op1_secrets
from .sharding import OP9_SQL, op9_sharding
from .substring_dedup import op7_substring_dedup
from .token_store import op13_tokens
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_html": op2_html,
    "op3_warc": op3_warc,
    "op4_language": op4_language,
    "op5_bpe": op5_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_minhash": op8_minhash,
    "op9_sharding": op9_sharding,
    "op10_chroma": op10_chroma,
    "op11_runs": op11_runs,
    "op12_resample": op12_resample,
    "op13_tokens": op13_tokens,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op9_sharding": OP9_SQL,
}
