"""Operations for preparing language-model training data at cluster scale.

Nothing else in the package imports this subpackage.  Every operator takes a
DataFrame with the columns it names and ignores any other column.
"""
