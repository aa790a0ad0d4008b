"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from talkloom.llm.collocations import OP11_SQL, op11_collocations
from talkloom.llm.conversations import op13_conversation_repair
from talkloom.llm.decontamination import OP12_SQL, op12_contamination
from talkloom.llm.html_text import op4_main_text
from talkloom.llm.mixing import OP9_SQL, op9_poisson_mixture
from talkloom.llm.neardup_vectors import OP6_SQL, op6_near_vectors
from talkloom.llm.packing import op10_packed_sequences
from talkloom.llm.sharding import op3_feistel_shards
from talkloom.llm.simhash import op7_simhash_groups
from talkloom.llm.tokens import op5_token_counts
from talkloom.llm.topk import OP2_SQL, op2_pivot_top_k
from talkloom.llm.toxicity import op1_toxicity
from talkloom.llm.warc import OP8_SQL, op8_arc_to_warc

QUERIES = {
    f.__name__: f for f in (
        op1_toxicity, op2_pivot_top_k, op3_feistel_shards, op4_main_text, op5_token_counts, op6_near_vectors,
        op7_simhash_groups, op8_arc_to_warc, op9_poisson_mixture, op10_packed_sequences,
        op11_collocations, op12_contamination, op13_conversation_repair,
    )
}
ORACLE_SQL = {
    "op2_pivot_top_k": OP2_SQL, "op6_near_vectors": OP6_SQL, "op8_arc_to_warc": OP8_SQL, "op9_poisson_mixture": OP9_SQL,
    "op11_collocations": OP11_SQL, "op12_contamination": OP12_SQL,
}
