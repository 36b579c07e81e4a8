"""Scoring, segmentation, candidate choice and leaderboard operators."""
