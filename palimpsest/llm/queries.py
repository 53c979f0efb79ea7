"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP7_SQL, op7_decontaminate
from .importance import OP11_SQL, op11_importance_resampling
from .language import op8_language_centroids
from .lattice import op13_lattice_likelihood
from .middle import OP12_SQL, op12_fill_in_middle
from .packing import op4_exact_complement_packing
from .privacy import op3_personal_data
from .quality import op1_quality_fm
from .repeats import op10_prefix_doubling
from .rules import op9_quality_rules
from .secrets import op6_randomness_battery
from .sharding import op5_jump_sharding
from .simhash import op2_simhash_mih

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_simhash_mih": op2_simhash_mih,
    "op3_personal_data": op3_personal_data,
    "op4_exact_complement_packing": op4_exact_complement_packing,
    "op5_jump_sharding": op5_jump_sharding,
    "op6_randomness_battery": op6_randomness_battery,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_centroids": op8_language_centroids,
    "op9_quality_rules": op9_quality_rules,
    "op10_prefix_doubling": op10_prefix_doubling,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lattice_likelihood": op13_lattice_likelihood,
}

ORACLE_SQL: dict[str, str] = {"op7_decontaminate": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
