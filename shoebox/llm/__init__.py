"""Operations of a large-scale training-data pipeline, one module each.

``queries.py`` lists the queries that the driver contract registers. Nothing
outside this folder (and ``corpus_pipeline.py``) imports it.
"""
