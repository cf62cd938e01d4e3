"""Relational operators: statistics, resampling, matching, diversity, sampling, corpora and gates."""
