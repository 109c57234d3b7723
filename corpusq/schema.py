"""Schemas of the layers."""

RAW = "review_id string, user_id string, business_id string, stars double, useful bigint, funny bigint, cool bigint, text string, date string"
RAW_COLUMNS = ["review_id", "user_id", "business_id", "stars", "useful", "funny", "cool", "date", "text"]
FEATURE_COLUMNS = [*RAW_COLUMNS, "token_count", "chunk_count", "avg_chunk_tokens", "min_chunk_tokens", "max_chunk_tokens", "chunk_quality_flag", "is_duplicate", "duplicate_cluster_id", "has_pii", "pii_types"]
SCORE_COLUMNS = ["chunk_score", "duplicate_score", "pii_score", "index_readiness_score", "index_ready", "recommendation"]
SCORED_COLUMNS = FEATURE_COLUMNS + SCORE_COLUMNS
