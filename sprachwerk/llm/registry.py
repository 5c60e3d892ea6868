"""Queries of this folder by name, and their SQL where SQL can express them."""

from sprachwerk.llm.decontaminate import OP8_SQL, op8_winnowing
from sprachwerk.llm.extract import op5_blocks
from sprachwerk.llm.licences import op7_licences
from sprachwerk.llm.materialise import op10_training_order
from sprachwerk.llm.packing import op6_packing
from sprachwerk.llm.quality import op4_quality
from sprachwerk.llm.sharding import op1_kd_tree
from sprachwerk.llm.simhash import op3_simhash
from sprachwerk.llm.topk import OP2_SQL, op2_pivot_topk
from sprachwerk.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_kd_tree": op1_kd_tree,
    "op2_pivot_topk": op2_pivot_topk,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_blocks": op5_blocks,
    "op6_packing": op6_packing,
    "op7_licences": op7_licences,
    "op8_winnowing": op8_winnowing,
    "op9_toxicity": op9_toxicity,
    "op10_training_order": op10_training_order,
}
ORACLES = {
    "op2_pivot_topk": OP2_SQL,
    "op8_winnowing": OP8_SQL,
}
