"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import op1_quality_rules, op11_topk, op12_clusters, op13_lexical
from .op1_quality_rules import op1_quality_rules as op1
from .op2_jaccard_join import op2_jaccard_join
from .op3_decontaminate import op3_decontaminate
from .op4_sharding import op4_sharding
from .op5_training_order import op5_training_order
from .op6_language import op6_language
from .op7_licenses import op7_licenses
from .op8_packing import op8_packing
from .op9_toxicity import op9_toxicity
from .op10_pii import op10_pii
from .op11_topk import op11_topk as op11
from .op12_clusters import op12_clusters as op12
from .op13_lexical import op13_lexical as op13

QUERIES = {
    "op1_quality_rules": op1,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontaminate": op3_decontaminate,
    "op4_sharding": op4_sharding,
    "op5_training_order": op5_training_order,
    "op6_language": op6_language,
    "op7_licenses": op7_licenses,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_topk": op11,
    "op12_clusters": op12,
    "op13_lexical": op13,
}

SQL = {"op1_quality_rules": op1_quality_rules.SQL, "op11_topk": op11_topk.SQL, "op12_clusters": op12_clusters.SQL, "op13_lexical": op13_lexical.SQL}
