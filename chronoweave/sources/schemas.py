"""Declared schemas of the inputs; nothing is inferred."""

EVENT = (
    "event_slot int, event_id string, event_kind string, event_subtype string, event_date string, event_end_date string, "
    "date_precision string, location string, commodity string, actor string, food_system_stage string, evidence_quote string, "
    "confidence_pct int, granularity_basis string, notes string, all_types string, episode_id string, label_status string"
)
RELATION = (
    "relation_id string, relation_slot int, subject_event_slot int, subject_event_id string, predicate string, relation string, "
    "object_event_slot int, object_event_or_policy_id string, policy_id string, relation_label string, evidence_quote string, "
    "confidence_pct int, notes string"
)
ANNOTATION = (
    "candidate_id string, pub_date string, source string, title string, url string, article_relevance string, east_java_basis string, "
    f"llm_confidence_pct string, events array<struct<{', '.join(':'.join(x.split()) for x in EVENT.split(', '))}>>, "
    f"relations array<struct<{', '.join(':'.join(x.split()) for x in RELATION.split(', '))}>>, extraction_model string, human_verified boolean, review_status string"
)


def _struct(ddl: str) -> str:
    """Top-level 'a t, b t' as 'struct<a:t,b:t>'."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = ddl[at:i].strip().partition(" ")
            parts.append(f"{name}:{kind}")
            at = i + 1
    return f"struct<{','.join(parts)}>"


ANNOTATION_STRUCT = _struct(ANNOTATION)
CHECKPOINT = f"article_id string, status string, model string, extraction_route string, annotation {ANNOTATION_STRUCT}, _corrupt_record string"
QUEUE = (
    "article_id string, body string, body_chars int, evidence_window string, explicit_connection_signal boolean, heuristic_commodities array<string>, "
    "heuristic_disruption_types array<string>, heuristic_locations array<string>, heuristic_response_types array<string>, human_verified boolean, "
    "label_status string, near_copy_cluster_id string, pub_date string, publisher_family string, roles array<string>"
)
PACKET = "article_id string, blind_payload struct<source_sentences:array<struct<sentence_id:int,text:string>>>"
BATCHES = "batches array<struct<batch:int,article_ids:array<string>>>"
CANDIDATES = "query_response_id string, candidate_disruption_id string, known_positive string, hardness_score double"
ARTICLE_NODE = "article_id string, publisher_id string, source_channel_key string, publication_datetime string, article_relevance string, extraction_source string, extraction_model string, title string"
EVENT_NODE = (
    "event_id string, node_kind string, event_subtype string, all_types string, event_kind string, event_date string, event_end_date string, "
    "date_precision string, report_time string, available_date string, commodity_id string, location_id string, stage_id string, actor_ids string, "
    "article_id string, publisher_id string, extraction_confidence int, extraction_source string, episode_id string, granularity_basis string, "
    "label_status string, human_verified boolean"
)
EDGE = (
    "src_id string, src_type string, relation string, dst_id string, dst_type string, event_time string, report_time string, available_date string, "
    "confidence double, assertion_derivation string, extraction_method string, support_assertion_count int, evidence_quote string"
)
