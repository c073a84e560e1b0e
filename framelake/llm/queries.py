"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import mixing
from .bpe import op8_byte_bpe
from .chat import op3_chat_format
from .gif import op4_gif_media
from .html import op9_html_extract
from .hyperminhash import op5_minhash_near_dedup
from .importance import op6_importance_resampling
from .licences import op7_licence_scan
from .mixing import op2_mixing
from .onebit import op10_onebit_search
from .token_records import op1_token_records

QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_mixing": op2_mixing,
    "op3_chat_format": op3_chat_format,
    "op4_gif_media": op4_gif_media,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_licence_scan": op7_licence_scan,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_html_extract": op9_html_extract,
    "op10_onebit_search": op10_onebit_search,
}

ORACLE: dict[str, str] = {
    "op2_mixing": mixing.oracle(),
}
