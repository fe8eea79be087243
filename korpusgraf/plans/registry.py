"""Every registered query of the library and its SQL twin."""

from __future__ import annotations

from korpusgraf.plans import assembly_queries, change_queries, choice_queries, context_queries, flow_queries, graph_queries, layer_queries, link_queries, lookup_queries, model_queries, pass_queries, rank_queries, receiver_queries, rollup_queries, save_queries, search_queries, source_queries, structure_queries, symbol_queries, text_queries

PARTS = (rollup_queries, search_queries, graph_queries, link_queries, text_queries, structure_queries, change_queries, context_queries, choice_queries, pass_queries, source_queries, assembly_queries, symbol_queries, rank_queries, receiver_queries, flow_queries, model_queries, save_queries, layer_queries, lookup_queries)
QUERIES: dict = {k: v for part in PARTS for k, v in part.QUERIES.items()}
SQL: dict[str, str] = {k: v for part in PARTS for k, v in part.SQL.items()}
