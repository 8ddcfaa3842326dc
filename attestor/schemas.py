"""Explicit schemas of the persistent tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

LOCATOR = "struct<url: string, page_number: int, paragraph_number: int, text_anchor: string>"
CITATION = f"struct<citation_id: string, source_url: string, source_title: string, excerpt: string, locator: {LOCATOR}>"

COMPANIES = "company_id string not null, canonical_name string not null, aliases array<string>, website string"
SOURCES = "source_id string not null, source_type string not null, title string, canonical_url string"
VERSIONS = "source_version_id string not null, source_id string not null, content_sha256 string not null, retrieved_at timestamp not null, published_at timestamp, is_current boolean not null, supersedes string, metadata map<string, string>"
CHUNKS = f"chunk_id string not null, source_id string not null, source_version_id string not null, company_id string, knowledge_layer string not null, text string not null, tags array<string>, citation {CITATION}, metadata map<string, string>"
FACTS = "fact_id string not null, company_id string not null, chunk_id string not null, subject string, predicate string, object_value string, fact_type string, event_time timestamp, quantitative_value double, quantitative_unit string, currency string, period string, dimension string, source_id string, quality string"
MILESTONES = "company_id string not null, template_id string, milestone_id string not null, status string not null, supporting array<string>, contradicting array<string>"
OBSERVATIONS = "entity_id string not null, indicator string not null, score double, evidence array<string>, rationale string"

#: Enumerations that the columns may hold.
SOURCE_TYPES = ("uploaded_document", "company_official", "government", "regulatory", "exchange_disclosure", "patent", "paper", "standard", "news", "registry", "web", "other")
LAYERS = ("enterprise", "domain", "lifecycle", "standard", "regulation", "financial_rule", "general")
MILESTONE_STATUS = ("supported", "limited_support", "conflict", "no_evidence")


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
