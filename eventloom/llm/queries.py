"""The package's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from eventloom.llm import op1_decontaminate as op1
from eventloom.llm import op10_surrogates as op10
from eventloom.llm import op11_prefix_trie as op11
from eventloom.llm import op12_substrings as op12
from eventloom.llm import op13_merkle as op13
from eventloom.llm import op2_suffix_array as op2
from eventloom.llm import op3_fuzzy_lines as op3
from eventloom.llm import op4_quality_rules as op4
from eventloom.llm import op5_minhash as op5
from eventloom.llm import op6_toxicity as op6
from eventloom.llm import op7_language_id as op7
from eventloom.llm import op8_licenses as op8
from eventloom.llm import op9_mixing as op9


def queries() -> dict:
    return {
        "op1_decontaminate": op1.op1_decontaminate,
        "op2_suffix_array": op2.op2_suffix_array,
        "op3_fuzzy_lines": op3.op3_fuzzy_lines,
        "op4_quality_rules": op4.op4_quality_rules,
        "op5_minhash": op5.op5_minhash,
        "op6_toxicity": op6.op6_toxicity,
        "op7_language_id": op7.op7_language_id,
        "op8_licenses": op8.op8_licenses,
        "op9_mixing": op9.op9_mixing,
        "op10_surrogates": op10.op10_surrogates,
        "op11_prefix_trie": op11.op11_prefix_trie,
        "op12_substrings": op12.op12_substrings,
        "op13_merkle": op13.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": op4.ORACLE_SQL,
        "op9_mixing": op9.ORACLE_SQL,
        "op11_prefix_trie": op11.ORACLE_SQL,
        "op12_substrings": op12.ORACLE_SQL,
        "op13_merkle": op13.ORACLE_SQL,
    }
