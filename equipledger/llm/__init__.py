"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Functions are shipped to Python workers by value, so that workers need not have this package installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from equipledger.llm import audit_repair, quality_rules  # noqa: E402
from equipledger.llm.crf_lang import op2_crf_language_id  # noqa: E402
from equipledger.llm.emb_int8 import op9_embedding_near_dedup  # noqa: E402
from equipledger.llm.gru_lm import op6_gru_lm  # noqa: E402
from equipledger.llm.kd_shards import op1_kd_shards  # noqa: E402
from equipledger.llm.kn_quality import op3_kn_quality  # noqa: E402
from equipledger.llm.periodic_runs import op12_periodic_runs  # noqa: E402
from equipledger.llm.pfair import op10_pfair_mix  # noqa: E402
from equipledger.llm.pii import op4_pii  # noqa: E402
from equipledger.llm.simhash import op7_simhash_near_dedup  # noqa: E402
from equipledger.llm.sp_lattice import op8_sentencepiece  # noqa: E402
from equipledger.llm.syncmers import op5_closed_syncmers  # noqa: E402

QUERIES = {f.__name__: f for f in (
    op1_kd_shards, op2_crf_language_id, op3_kn_quality, op4_pii, op5_closed_syncmers, op6_gru_lm, op7_simhash_near_dedup,
    op8_sentencepiece, op9_embedding_near_dedup, op10_pfair_mix, audit_repair.op11_conversation_repair,
    op12_periodic_runs, quality_rules.op13_quality_rules)}
ORACLES: dict[str, str] = {"op11_conversation_repair": audit_repair.ORACLE, "op13_quality_rules": quality_rules.ORACLE}
