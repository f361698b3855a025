"""docmeter.functions."""
