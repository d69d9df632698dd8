"""The operators of this subpackage as named queries over the given tables, and their check SQL where SQL can say it."""

from __future__ import annotations

from lakewitness.llm import byte_pairs, chat, decontaminate, link_graph, manifest, mixing, near_copies, prefix_trie, quality, repeats, secret_scan, sharding, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        link_graph.op1_link_graph_filter,
        secret_scan.op2_secret_ownership,
        chat.op3_chat_round_trip,
        near_copies.op4_dart_minhash,
        mixing.op5_poisson_mixture,
        quality.op6_quality_fences,
        decontaminate.op7_template_windows,
        sharding.op8_hash_tree_shards,
        toxicity.op9_ftrl_toxicity,
        repeats.op10_prefix_doubling,
        byte_pairs.op11_bpe_matrices,
        manifest.op12_merkle_manifest,
        prefix_trie.op13_conversation_trie,
    )
}
ORACLES = {
    "op1_link_graph_filter": link_graph.OP1_SQL,
    "op2_secret_ownership": secret_scan.OP2_SQL,
    "op3_chat_round_trip": chat.OP3_SQL,
    "op5_poisson_mixture": mixing.OP5_SQL,
    "op6_quality_fences": quality.OP6_SQL,
    "op8_hash_tree_shards": sharding.OP8_SQL,
    "op12_merkle_manifest": manifest.OP12_SQL,
    "op13_conversation_trie": prefix_trie.OP13_SQL,
}
