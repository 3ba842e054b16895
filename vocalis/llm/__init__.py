"""Operations of a training-data pipeline over the documents/embeddings tables.

Nothing else in the library imports this subpackage; ``catalog`` registers
one query per operator.
"""
