"""Operators for building training corpora: documents in, decisions and packed token data out."""
