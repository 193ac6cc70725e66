"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from tessella.llm.decontamination import OP12_SQL, op12_decontamination
from tessella.llm.divergence import OP13_SQL, op13_source_divergence
from tessella.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from tessella.llm.fingerprints import op7_fingerprints
from tessella.llm.language_id import op1_language_id
from tessella.llm.line_dedup import OP4_SQL, op4_line_dedup
from tessella.llm.mixing import OP3_SQL, op3_mixing
from tessella.llm.near_dedup import op8_near_dedup
from tessella.llm.packing import op5_packing
from tessella.llm.pii import op10_pii
from tessella.llm.spelling import op11_spelling
from tessella.llm.suffix_dedup import op9_suffix_dedup
from tessella.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_near_dedup": op8_near_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pii": op10_pii,
    "op11_spelling": op11_spelling,
    "op12_decontamination": op12_decontamination,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op12_decontamination": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
