"""docmeter.streaming."""
