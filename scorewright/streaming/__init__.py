"""Boards that follow a growing folder of result files."""
