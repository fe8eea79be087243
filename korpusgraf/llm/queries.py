"""The registered queries of the operators, each over its whole table, with the SQL for those that SQL expresses."""

from __future__ import annotations

from korpusgraf.llm import audit, chat, langid, lattice, licences, mixing, packing, secrets, sharding, simhash, sketches, spelling, topk
from korpusgraf.llm.common import table

QUERIES = {
    "op1_simhash_near_dedup": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op2_language_id": lambda spark, d: langid.identify(table(spark, d, "documents")),
    "op3_exact_top_k": lambda spark, d: topk.search_embeddings(table(spark, d, "embeddings")),
    "op4_license_scan": lambda spark, d: licences.scan(table(spark, d, "documents")),
    "op5_secret_scan": lambda spark, d: secrets.scan(table(spark, d, "documents")),
    "op6_source_mixing": lambda spark, d: mixing.mixture(table(spark, d, "documents")),
    "op7_fingerprints": lambda spark, d: sketches.fingerprints(table(spark, d, "documents")),
    "op8_sharding": lambda spark, d: sharding.shard(table(spark, d, "documents")),
    "op9_lm_scoring": lambda spark, d: lattice.score(table(spark, d, "documents")),
    "op10_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op11_filter_audit": lambda spark, d: audit.audit(table(spark, d, "documents"), table(spark, d, "labels")),
    "op12_spelling_variants": lambda spark, d: spelling.variants(table(spark, d, "documents")),
    "op13_chat_formatting": lambda spark, d: chat.chats(table(spark, d, "conversations")),
}
SQL = {"op3_exact_top_k": topk.SQL, "op4_license_scan": licences.SQL, "op11_filter_audit": audit.SQL, "op12_spelling_variants": spelling.SQL, "op13_chat_formatting": chat.SQL}
