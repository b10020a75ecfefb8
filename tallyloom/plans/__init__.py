"""From a question, or a statement, to a DataFrame."""
