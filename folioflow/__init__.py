"""Spark jobs for document question-answering data: ingestion, retrieval, usage metering, streams."""
