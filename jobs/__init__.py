"""Runnable jobs: `python -m jobs.<name> jobs/<name>.json`."""
