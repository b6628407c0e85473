"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from . import bpe, conversation_repair, exact_dedup, lexical_search, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, sharding, token_counts, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sharding": sharding.op2_sharding,
    "op3_warc": warc.op3_warc,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_packing": packing.op6_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_bpe": bpe.op10_bpe,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op7_token_counts": token_counts.OP7_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op12_secret_scan": secret_scan.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
