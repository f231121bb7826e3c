"""Label views, storage and test-data graphs."""
