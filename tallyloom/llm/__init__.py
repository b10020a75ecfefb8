"""Training-data operators over a corpus; nothing else in the library imports this subpackage."""
