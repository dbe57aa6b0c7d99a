"""All query modules of the subpackage."""

from kbforge.llm import history_queries, markup_queries, pii_queries, secrets_queries, sizes_queries, spam_queries

MODULES = [pii_queries, secrets_queries, sizes_queries, history_queries, markup_queries, spam_queries]
