"""Operations for preparing training text: mixing, formatting, filtering, deduplication, tokenisation and more."""
