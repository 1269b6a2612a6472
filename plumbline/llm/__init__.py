"""Operations of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the thin queries over the test tables.
"""
