"""Operations of a training-data pipeline, each built by one named method.

Nothing else in the library imports this subpackage.
"""
