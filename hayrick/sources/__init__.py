"""Readers of worktrees, files, symbols and suites, and the snapshot store."""
