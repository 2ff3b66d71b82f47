"""Tables, the catalog, and readers and writers."""
