"""Explicit schemas of every dataset; nothing is inferred."""

CORPUS = "id long, doc_id long, title string, context string, text string, content string"
QUESTIONS = "id string, question string, answer string, question_type string"
SOURCES = "map<string, array<struct<doc_id: long, chunk_idx: int, source_text: string>>>"
FAILED = "doc_id long, chunk_idx int, chunk_text string, error string"
TEXT_REF = "struct<doc_id: long, chunk_idx: int, text: string>"
ANSWERS = "id string, rag_answer string, llm_answer string, answer string, final_answer string, rounds int"
# A list in a retrieval may hold objects or plain texts, so it is read as its JSON text first.
RETRIEVALS = "id string, source_sentences string, chunks string, retrieved_chunks string, history string"
HISTORY = "array<struct<round: int, query: string, answer: string, context: string, evaluation: struct<sufficient: boolean, reason: string, sub_question: string>, new_chunks_count: int>>"
QUERIES = "id string, question string, answer string, supporting_facts array<struct<doc_id: long, text: string>>, type string, reasoning string, bridges array<string>, entity string, num_hops int"
VALIDATION = "struct<answerable: struct<passed: boolean, generated_answer: string, reason: string>, shortcut: struct<passed: boolean, shortcut_type: string, reason: string>, leak: struct<passed: boolean, exact_match: boolean, llm_knows: boolean, llm_answer: string, leak_type: string, reason: string>, overall_passed: boolean>"
EVALUATIONS = "id string, semantic_f1 double, coverage double, faithfulness_hard double, faithfulness_soft double, llm_label string, llm_reason string"
EMBEDDINGS = "doc_id long, chunk_idx int, text string, embedding array<float>"
TRIPLETS = "subject string, relation string, object string, doc_id long, chunk_idx int, source_text string, pos long"
VERTICES = "entity_id long, entity string"
EDGES = "src long, dst long, relation string, doc_id long"
INDEX = "row_id long, doc_id long, chunk_idx int, text string, embedding array<double>"
VECTORS = "item_id long, embedding array<double>"
SEMANTIC = "status string, total_embeddings long, embedding_dimension int, semantic_complexity struct<intrinsic_dimension: double, valid_samples: long>, semantic_distinguishability struct<avg_centroid_distance: double, std_centroid_distance: double, min_centroid_distance: double, max_centroid_distance: double>, semantic_interference struct<hubness_score: double, k: int, top_hubs: array<struct<chunk_index: long, occurrence: long>>>, debug_max_occurrence long, debug_mean_occurrence double"
STRUCTURE = "status string, basic_stats struct<n_nodes: long, n_edges: long, n_relations: long, density: double, avg_degree: double, n_isolated: long>, connectivity struct<n_components: long, largest: long, largest_ratio: double, connected: boolean>, centrality struct<avg_degree: double, max_degree: long, avg_centrality: double>, path_metrics struct<avg_path: double, diameter: long, n_nodes: long>, relation_metrics struct<n_relations: long, top: array<struct<relation: string, n: long>>>, avg_clustering double"
