"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from twinfold.llm.byte_bpe import op11_byte_bpe
from twinfold.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from twinfold.llm.langid import op4_langid
from twinfold.llm.license_scan import OP1_SQL, op1_license_scan
from twinfold.llm.mixing import OP8_SQL, op8_mixing
from twinfold.llm.packing import op5_packing
from twinfold.llm.quality import OP10_SQL, op10_quality
from twinfold.llm.sharding import op2_sharding
from twinfold.llm.simhash import op6_simhash
from twinfold.llm.token_alignment import op12_token_alignment
from twinfold.llm.toxicity import op3_toxicity
from twinfold.llm.url_filter import OP9_SQL, op9_url_filter
from twinfold.llm.whitening import op13_whitening

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_langid": op4_langid,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op1_license_scan": OP1_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_quality": OP10_SQL,
}
