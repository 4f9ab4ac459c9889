"""Sources and sinks: tables, keyed caches, document stores, transcripts as files."""
