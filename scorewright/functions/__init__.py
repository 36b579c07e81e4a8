"""Column functions on transcripts and distances."""
