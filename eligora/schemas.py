"""Table schemas.

``crit_code`` is the text code of a criterion ("C-001"), ``criterion_id`` its
surrogate key.  Money stays DOUBLE, as amounts are compared and rounded as
binary floats.  All are DDL texts, as every reader and writer takes them.
"""

TENDERS = ("id BIGINT, name STRING NOT NULL, filename STRING, file_hash STRING, "
           "full_text STRING, created_at TIMESTAMP")
CRITERIA = ("id BIGINT, tender_id BIGINT NOT NULL, crit_code STRING NOT NULL, "
            "description STRING NOT NULL, category STRING NOT NULL, mandatory BOOLEAN NOT NULL, "
            "threshold STRING, expected_evidence STRING, source_section STRING, "
            "confirmed BOOLEAN NOT NULL, created_at TIMESTAMP")
BIDDERS = ("id BIGINT, tender_id BIGINT NOT NULL, name STRING NOT NULL, created_at TIMESTAMP")
DOCUMENTS = ("id BIGINT, bidder_id BIGINT, tender_id BIGINT, filename STRING NOT NULL, "
             "file_hash STRING, file_type STRING, doc_category STRING, full_text STRING, "
             "page_count INT, min_ocr_confidence DOUBLE, is_tender_doc BOOLEAN, created_at TIMESTAMP")
EVIDENCE = ("id BIGINT, bidder_id BIGINT NOT NULL, criterion_id BIGINT NOT NULL, "
            "extracted_value STRING, normalized_value DOUBLE, raw_text STRING, "
            "source_document STRING, source_page INT, confidence DOUBLE, notes STRING, "
            "created_at TIMESTAMP")
VERDICTS = ("id BIGINT, bidder_id BIGINT NOT NULL, criterion_id BIGINT NOT NULL, "
            "verdict STRING NOT NULL, explanation STRING, confidence DOUBLE, created_at TIMESTAMP")
OVERRIDES = ("id BIGINT, verdict_id BIGINT NOT NULL, original_verdict STRING NOT NULL, "
             "new_verdict STRING NOT NULL, reason STRING NOT NULL, officer_name STRING, "
             "created_at TIMESTAMP")
AUDIT_LOG = ("id BIGINT, tender_id BIGINT, action STRING NOT NULL, details STRING, "
             "created_at TIMESTAMP")
VECTORS = ("id STRING, bidder_id BIGINT, kind STRING, source_document STRING, chunk_index INT, "
           "document STRING, embedding ARRAY<FLOAT>, ocr_confidence DOUBLE")
PAGE = ("page_num INT, text STRING, tables ARRAY<ARRAY<ARRAY<STRING>>>, "
        "ocr_confidence DOUBLE, is_scanned BOOLEAN")
MONEY = ("amount DOUBLE, currency STRING, confidence DOUBLE, method STRING")
THRESHOLD = ("operator STRING, value DOUBLE")

TABLES = {
    "tenders": TENDERS, "criteria": CRITERIA, "bidders": BIDDERS, "documents": DOCUMENTS,
    "evidence": EVIDENCE, "verdicts": VERDICTS, "officer_overrides": OVERRIDES,
    "audit_log": AUDIT_LOG,
}
