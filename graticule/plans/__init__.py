"""Iterative jobs: map training, tree and forest training, pruning, evaluation."""
