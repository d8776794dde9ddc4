"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tractlake.llm.decontaminate import OP8_SQL, op8_decontamination
from tractlake.llm.line_rules import op7_quality_rules
from tractlake.llm.mixing import op10_mixing
from tractlake.llm.ngram_join import OP2_SQL, op2_ngram_join
from tractlake.llm.quality import op4_quality
from tractlake.llm.secrets import op9_secrets
from tractlake.llm.sharding import op1_sharding
from tractlake.llm.suffix_dedup import op3_suffix_dedup
from tractlake.llm.toxicity import op5_toxicity
from tractlake.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL = {"op2_ngram_join": OP2_SQL, "op6_warc": OP6_SQL, "op8_decontamination": OP8_SQL}
