"""Tables, topics and the adapters that stand for network calls."""
