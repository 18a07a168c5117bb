"""Training-data operators over document tables; nothing outside this subpackage imports it."""
