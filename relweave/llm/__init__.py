"""Training-data operators: chat formatting, deduplication, quality, secrets, tokenization, mixing."""
