"""Runnable jobs: ``python -m jobs.document_index`` and ``python -m jobs.context_digest``."""
