"""Operations of a training-data pipeline: filtering, de-duplication, scoring, scanning, tokenising and packing of text.

Nothing else in the library imports this subpackage.
"""
