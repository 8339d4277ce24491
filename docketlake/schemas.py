"""Row types of the corpus, log, memory, cache and evaluation tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(S)
STRING_MAP = T.MapType(S, S)


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CHUNK_METADATA = _row(
    title=S, section=S, chunk_index=I, nature=S, court=S, canonical_citation=S, akn_uri=S, paragraph_range=S,
    pageindex_doc_id=S, sub_chunk=B, original_chunk_id=S, sub_index=I, source_document_key=S,
)
CHUNK = _row(
    chunk_id=S, doc_id=S, parent_doc_id=S, tree_node_id=S, chunk_text=S, section_path=S, start_char=I, end_char=I, num_tokens=I,
    language=S, doc_type=S, date_context=S, source_url=S, nature=S, year=I, chapter=S, authority_level=S, hierarchy_rank=I,
    binding_scope=S, subject_category=S, entities=T.MapType(S, STRINGS), metadata=CHUNK_METADATA, extra=STRING_MAP,
)
PARENT = _row(
    doc_id=S, doc_type=S, title=S, language=S, jurisdiction=S, chapter=S, act_number=S, act_year=S, version_date=S, akn_uri=S,
    canonical_citation=S, subject_category=S, authority_level=S, binding_scope=S, hierarchy_rank=I, content_tree=S, markdown=S,
    extra=_row(pdf_key=S, tree_nodes_count=L, markdown_length=L, processed_at=S),
)
NODE = _row(
    doc_id=S, path=T.ArrayType(I), kept_parent=T.ArrayType(I), breadcrumb=S, title=S, node_id=S, text=S, page_index=I, depth=I, ordinal=I,
)
SECTION = _row(title=S, paragraphs=STRINGS, content=S)
LEGISLATION_TREE = _row(doc_id=S, doc_type=S, parts=T.ArrayType(_row(title=S, sections=T.ArrayType(SECTION))))
JUDGMENT_TREE = _row(doc_id=S, doc_type=S, headnote=STRINGS, body=STRINGS)
VECTOR = _row(
    chunk_id=S, embedding=T.ArrayType(T.FloatType()), chunk_object_key=S, source_document_key=S, doc_type=S, language=S,
    parent_doc_id=S, tree_node_id=S, nature=S, chapter=S, date_context=S, authority_level=S, binding_scope=S, subject_category=S,
    num_tokens=L, year=L, hierarchy_rank=L,
)
POSTING = _row(term=S, chunk_no=L, dl=I, tf=L, chunk_id=S, doc_id=S, doc_type=S)
HIT = _row(query_id=S, chunk_id=S, doc_id=S, doc_type=S, source=S, rank=I, score=D, confidence=D)
QUERY_LOG = _row(
    request_id=S, ts=T.TimestampType(), user_hash=S, channel=S, query_text=S, response_topic=S, confidence=D, response_time_ms=L,
    status=S, session_id=S,
)
FEEDBACK = _row(request_id=S, ts=T.TimestampType(), user_hash=S, rating=I, comment=S)
LEGISLATION_ROW = _row(
    akn_uri=S, nature=S, title=S, chapter=S, work_frbr_uri=S, expression_frbr_uri=S, effective_date=S, year=I, source_url=S,
)
JUDGMENT_ROW = _row(
    akn_uri=S, case_name=S, citation=S, court=S, court_code=S, judgment_date=S, year=I, case_number=S, parties=T.MapType(S, STRINGS),
    judges=STRINGS, topics=STRINGS, citation_full=S, language=S, work_frbr_uri=S, expression_frbr_uri=S, source_url=S, pdf_name=S,
)
MESSAGE = _row(session_id=S, turn=L, role=S, content=S, meta=STRING_MAP)
PROFILE = _row(
    user_id=S, query_count=L, area_frequency=T.MapType(S, L), legal_interests=STRINGS, last_query_complexity=S, detected_user_type=S,
)
CACHE_ENTRY = _row(
    user_type=S, key=S, query=S, embedding=T.ArrayType(T.FloatType()), response=STRING_MAP, created_at=T.TimestampType(), ttl_s=I,
)
GOLDEN_QUERY = _row(
    id=S, query=S, category=S, expected_answer=S, expected_sources=STRINGS, expected_topics=STRINGS, expected_doc_types=STRINGS,
    expected_confidence_min=D, complexity=S, tags=STRINGS, min_precision=D,
)
EXPERIMENT_RESULT = _row(
    experiment_id=S, variant=S, user_id=S, latency_ms=D, citation_count=I, grounding_score=D, metrics=T.MapType(S, D), ts=T.TimestampType(),
)
WAITLIST_ENTRY = _row(waitlist_id=S, email=S, joined_at=T.TimestampType(), source=S, metadata=STRING_MAP)
PARSE_JOB = _row(doc_id=S, status=S, started=D, finished=D)
