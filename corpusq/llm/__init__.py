"""Operations of a training-data pipeline over very large corpora.

Nothing else in corpusq imports this package.
"""
