"""Operations for preparing training data: ten operators, their queries and their SQL."""
