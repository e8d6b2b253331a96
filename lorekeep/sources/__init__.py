"""Scans and sinks: import bundles, page extraction, snapshots, partitioned output."""
