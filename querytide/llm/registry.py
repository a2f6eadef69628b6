"""All queries of this subpackage and their check SQL."""

import corpus_pipeline
from querytide.llm import queries, sql

QUERIES = {name: query for name, query in vars(queries).items() if name.startswith("op")} | {"pipeline": corpus_pipeline.run}
CHECK = sql.CHECK | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
