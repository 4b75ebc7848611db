"""Readers for claims tables, code lists and labels; writers for results."""

from prevalo.sources.claims import Claims, read_claims, read_claims_tables, store_claims
from prevalo.sources.code_list import code_frame, read_code_list
from prevalo.sources.results import write_result
from prevalo.sources.staging import bounded_tasks, clear_staged, stage, staging_scope

__all__ = [
    "Claims",
    "bounded_tasks",
    "clear_staged",
    "code_frame",
    "read_claims",
    "read_claims_tables",
    "read_code_list",
    "stage",
    "staging_scope",
    "store_claims",
    "write_result",
]
