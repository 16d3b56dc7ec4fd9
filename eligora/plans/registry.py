"""All registered queries: name -> (plan, oracle SQL or None)."""

from eligora.plans import index_queries, model_queries, money_queries, table_queries, text_queries, vector_queries, verdict_queries

ALL = {**verdict_queries.QUERIES, **table_queries.QUERIES, **text_queries.QUERIES, **money_queries.QUERIES,
       **vector_queries.QUERIES, **model_queries.QUERIES, **index_queries.QUERIES}
