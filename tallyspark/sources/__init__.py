"""Readers and writers: journals, OpenTelemetry spans, git logs, rosters, bundles, tables."""
