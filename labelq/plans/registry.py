"""All registered queries of the library and their DuckDB SQL."""

from labelq.plans import file_oracle, file_queries, oracle, queries, scene_oracle, scene_queries

QUERIES = {**queries.QUERIES, **scene_queries.QUERIES, **file_queries.QUERIES}
ORACLE_SQL = {**oracle.ORACLE_SQL, **scene_oracle.ORACLE_SQL, **file_oracle.ORACLE_SQL}
