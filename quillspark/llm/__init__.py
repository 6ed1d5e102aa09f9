"""Operations for preparing language-model training data at scale.

Nothing outside this subpackage imports it; ``registry`` holds its queries and their SQL.
"""
