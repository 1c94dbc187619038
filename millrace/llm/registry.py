"""Queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe_codec import op9_bpe_codec
from .compression_quality import op5_compression_quality
from .divide_skip_join import op8_divide_skip_join
from .importance_resampling import OP11_SQL, op11_importance_resampling
from .kneser_ney_toxicity import op7_kneser_ney_toxicity
from .line_chunks import op6_line_chunks
from .nn_descent import op1_nn_descent
from .pii_surrogates import op10_pii_surrogates
from .repetition_rules import OP12_SQL, op12_repetition_rules
from .superkmer_dedup import op3_superkmer_dedup
from .template_decontamination import op4_template_decontamination
from .turn_reassembly import OP13_SQL, op13_turn_reassembly
from .warc_chunks import OP2_SQL, op2_warc_chunks


def queries() -> dict:
    return {
        "op1_nn_descent": op1_nn_descent,
        "op2_warc_chunks": op2_warc_chunks,
        "op3_superkmer_dedup": op3_superkmer_dedup,
        "op4_template_decontamination": op4_template_decontamination,
        "op5_compression_quality": op5_compression_quality,
        "op6_line_chunks": op6_line_chunks,
        "op7_kneser_ney_toxicity": op7_kneser_ney_toxicity,
        "op8_divide_skip_join": op8_divide_skip_join,
        "op9_bpe_codec": op9_bpe_codec,
        "op10_pii_surrogates": op10_pii_surrogates,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_repetition_rules": op12_repetition_rules,
        "op13_turn_reassembly": op13_turn_reassembly,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_chunks": OP2_SQL,
        "op11_importance_resampling": OP11_SQL,
        "op12_repetition_rules": OP12_SQL,
        "op13_turn_reassembly": OP13_SQL,
    }
