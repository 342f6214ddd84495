"""The registered queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from .bpe import op6_bpe
from .classifier import op8_quality
from .decontaminate import OP2_SQL, op2_decontaminate
from .licences import OP1_SQL, op1_licences
from .linededup import OP4_SQL, op4_linededup
from .lm import op10_lm
from .neardup import op3_neardup
from .rules import OP7_SQL, op7_rules
from .substrings import op5_repeats
from .urls import OP9_SQL, op9_urls

QUERIES = {
    "op1_licences": op1_licences,
    "op2_decontaminate": op2_decontaminate,
    "op3_neardup": op3_neardup,
    "op4_linededup": op4_linededup,
    "op5_repeats": op5_repeats,
    "op6_bpe": op6_bpe,
    "op7_rules": op7_rules,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_lm": op10_lm,
}

ORACLE_SQL = {
    "op1_licences": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op4_linededup": OP4_SQL,
    "op7_rules": OP7_SQL,
    "op9_urls": OP9_SQL,
}
