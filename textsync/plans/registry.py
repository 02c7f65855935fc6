"""All registered queries and their SQL."""

from textsync.plans import book_oracle, book_queries, planted_oracle, planted_queries, store_oracle, store_queries, text_oracle, text_queries

QUERIES = {**text_queries.QUERIES, **book_queries.QUERIES, **planted_queries.QUERIES, **store_queries.QUERIES}
ORACLE = {**text_oracle.ORACLE, **book_oracle.ORACLE, **planted_oracle.ORACLE, **store_oracle.ORACLE}
