"""Operations of a training-data pipeline: tokens, PII, HTML, mixing, quality, passages, URLs, search, packing, joins.

Nothing else in this library imports this subpackage.
"""
