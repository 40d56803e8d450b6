"""The contract queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import op2_decontamination
from .fingerprint import op6_fingerprint
from .interactions import OP12_SQL, op12_interactions
from .jaccard import OP9_SQL, op9_jaccard
from .packing import op1_packing
from .quality import op5_quality
from .quotes import OP8_SQL, op8_quotes
from .sharding import op4_sharding
from .simhash import op13_simhash
from .spelling import OP11_SQL, op11_spelling
from .substrings import OP3_SQL, op3_substrings
from .toxicity import op7_toxicity
from .warc import op10_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_substrings": op3_substrings,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_fingerprint": op6_fingerprint,
    "op7_toxicity": op7_toxicity,
    "op8_quotes": op8_quotes,
    "op9_jaccard": op9_jaccard,
    "op10_warc": op10_warc,
    "op11_spelling": op11_spelling,
    "op12_interactions": op12_interactions,
    "op13_simhash": op13_simhash,
}

#: The rest learns, tokenises, or draws samples, which SQL cannot express; tests hold it against brute force.
ORACLE_SQL: dict[str, str] = {"op3_substrings": OP3_SQL, "op8_quotes": OP8_SQL, "op9_jaccard": OP9_SQL, "op11_spelling": OP11_SQL, "op12_interactions": OP12_SQL}
