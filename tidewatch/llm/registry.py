"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline
from tidewatch.llm.alignment import op11_align
from tidewatch.llm.decontaminate import op7_decontaminate
from tidewatch.llm.embeddings import op9_embeddings
from tidewatch.llm.line_dedup import op3_line_dedup
from tidewatch.llm.maxscore import OP12_SQL, op12_top_k
from tidewatch.llm.mixing import OP2_SQL, op2_mix
from tidewatch.llm.pii import op10_personal_data
from tidewatch.llm.quality import op1_quality
from tidewatch.llm.secrets import op5_secrets
from tidewatch.llm.simhash import op4_simhash
from tidewatch.llm.toxicity import op6_toxicity
from tidewatch.llm.url_filter import OP8_SQL, op8_url_filter
from tidewatch.llm.whitening import op13_whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    **{
        q.__name__: q
        for q in (
            op1_quality, op2_mix, op3_line_dedup, op4_simhash, op5_secrets, op6_toxicity,
            op7_decontaminate, op8_url_filter, op9_embeddings, op10_personal_data, op11_align, op12_top_k,
            op13_whitening,
        )
    },
}
ORACLES = {"op2_mix": OP2_SQL, "op8_url_filter": OP8_SQL, "op12_top_k": OP12_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
