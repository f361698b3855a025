"""docmeter.operators."""
