"""newsgraph: article ETL, RDF triples, entity extraction and profiling as Spark DataFrame jobs."""
