"""Query modules of the subpackage."""

from fundloom.llm import queries_abuse, queries_grants, queries_matching, queries_names, queries_subjects, queries_tokens

MODULES = [queries_abuse, queries_grants, queries_matching, queries_names, queries_subjects, queries_tokens]
