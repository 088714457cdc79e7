"""Pure column expressions: text, parsing, banks, display."""
