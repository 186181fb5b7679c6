"""Part of stemloom."""
