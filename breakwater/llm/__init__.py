"""Training-data operators: one module per operator, their queries in ``queries``.

Nothing outside this subpackage (and ``corpus_pipeline``) imports it.
"""
