"""docmeter.sources."""
