"""Operations of a training-data pipeline, one module each.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.  Each module
holds the operator in a general form (DataFrames in, DataFrames out);
``queries.py`` holds the registered queries and ``oracles.py`` their SQL.
"""
