"""Whole runs: profiling, fitted cleaning, audit and control."""
