"""Phonological analytics over IPA transcriptions, on Spark DataFrames."""
