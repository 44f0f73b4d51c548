"""Training-data operators at corpus scale: tokenising, exact and approximate
vector search, de-duplication, toxicity, quality and source mixing.

Nothing outside this subpackage imports it; ``queries.py`` registers one query
per operator."""
