"""Operations of a training-data pipeline: dedup, secrets, language, packing, tokens, markup, neighbours.

Nothing outside this folder imports it. Queries are in ``queries``, the corpus pipeline in
``corpus_pipeline.py`` at the top of the repository.
"""
