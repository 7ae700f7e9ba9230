"""Text normalisation and other column expressions."""
